"""Address spaces: what the set-oriented operators need to know of an address.

``V4`` addresses are BIGINT. ``V6`` addresses, which also hold IPv4 networks in
``::/96``, are struct<c int, h bigint, l bigint>: both halves with their sign
bit flipped, so that Spark's order of structs is the order of addresses, and a
carry that is 1 only for the end of the space. All arithmetic is on columns.

A shard is a range of addresses; its number never falls as addresses rise. The
number of shards is fixed, so one row a shard may meet in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGN = -(1 << 63)
WIDE = "struct<c:int,h:bigint,l:bigint>"


@dataclass(frozen=True)
class Space:
    bits: int

    def mask(self, at: Column, plen: Column) -> Column:
        """Network address of the prefix of this length that holds ``at``."""
        raise NotImplementedError

    def end(self, lo: Column, plen: Column) -> Column:
        """The address after a prefix's last one."""
        raise NotImplementedError

    def shard(self, at: Column) -> Column:
        raise NotImplementedError

    def zeros(self, at: Column) -> Column:
        """How many of the last bits of an address that isn't 0 are 0."""
        raise NotImplementedError

    def literal(self, n: int) -> Column:
        """Column of an address given as a number, up to the end of the space."""
        raise NotImplementedError


def _one(shift: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), shift)


class _Narrow(Space):
    def mask(self, at: Column, plen: Column) -> Column:
        return at - at % _one(F.lit(32) - plen)

    def end(self, lo: Column, plen: Column) -> Column:
        return lo + _one(F.lit(32) - plen)

    def shard(self, at: Column) -> Column:
        return F.shiftright(at, 16)

    def zeros(self, at: Column) -> Column:
        return F.bit_count(F.bitwise_not(at).bitwiseAND(at - 1))

    def literal(self, n: int) -> Column:
        return F.lit(n).cast("long")


def wide(high: Column, low: Column, carry: Column | None = None) -> Column:
    """A V6 address of two unsigned 64-bit halves held as BIGINT."""
    c = F.lit(0) if carry is None else carry
    return F.struct(c.cast("int").alias("c"), high.bitwiseXOR(F.lit(_SIGN)).alias("h"), low.bitwiseXOR(F.lit(_SIGN)).alias("l"))


def halves(at: Column) -> tuple[Column, Column]:
    """The unsigned halves of a V6 address as BIGINT."""
    return at["h"].bitwiseXOR(F.lit(_SIGN)), at["l"].bitwiseXOR(F.lit(_SIGN))


def _cut(half: Column, keep: Column) -> Column:
    """The first ``keep`` bits of a half (0 to 64)."""
    mask = F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(64) - F.greatest(keep, F.lit(1)))
    return F.when(keep <= 0, F.lit(0).cast("long")).when(keep >= 64, half).otherwise(half.bitwiseAND(mask))


def _next_up(half: Column) -> Column:
    """One more, as unsigned numbers; all ones become 0."""
    return F.when(half == -1, F.lit(0).cast("long")).when(half == (1 << 63) - 1, F.lit(_SIGN)).otherwise(half + 1)


def _trailing(half: Column) -> Column:
    """Zero bits at the end of a half that isn't 0."""
    return F.when(half == _SIGN, 63).otherwise(F.bit_count(F.bitwise_not(half).bitwiseAND(half - 1)))


class _Wide(Space):
    def mask(self, at: Column, plen: Column) -> Column:
        h, l = halves(at)
        return wide(_cut(h, plen), _cut(l, plen - 64))

    def end(self, lo: Column, plen: Column) -> Column:
        h, l = halves(lo)
        rest = lambda keep: F.bitwise_not(_cut(F.lit(-1).cast("long"), keep))
        last_h, last_l = h.bitwiseOR(rest(plen)), l.bitwiseOR(rest(plen - 64))
        over = last_l == -1
        return wide(F.when(over, _next_up(last_h)).otherwise(last_h), _next_up(last_l), F.when(over & (last_h == -1), 1).otherwise(0))

    def shard(self, at: Column) -> Column:
        h, l = halves(at)
        narrow = (h == 0) & (F.shiftrightunsigned(l, 32) == 0)
        return F.when(at["c"] == 1, F.lit((1 << 16) + (1 << 20))).when(narrow, F.shiftright(l, 16)).otherwise((1 << 16) + F.shiftrightunsigned(h, 44))

    def zeros(self, at: Column) -> Column:
        h, l = halves(at)
        return F.when(l != 0, _trailing(l)).otherwise(64 + _trailing(h))

    def literal(self, n: int) -> Column:
        c, n = divmod(n, 1 << 128)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return wide(F.lit(signed(n >> 64)).cast("long"), F.lit(signed(n & ((1 << 64) - 1))).cast("long"), F.lit(c))


V4, V6 = _Narrow(32), _Wide(128)
#: Networks of IPv4 in a V6 space lie at this depth and below.
IPV4_DEPTH = 96
