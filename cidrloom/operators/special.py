"""Reserved and aliased networks: rejection, holes and alias rewriting."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addr import ipv4_prefix_text
from ..functions.space import IPV4_DEPTH, V4, Space, halves
from .overlay import to_prefixes, total_cover

#: Adjacent equal neighbours are already one network, as the tree stores them.
RESERVED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/29", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3",
)
RESERVED_V6 = (
    "100::/64", "2001:1::/32", "2001:2::/31", "2001:4::/30", "2001:8::/29", "2001:10::/28",
    "2001:20::/27", "2001:40::/26", "2001:80::/25", "2001:100::/24", "2001:db8::/32",
    "fc00::/7", "fe80::/10", "ff00::/8",
)
#: IPv6 networks whose embedded IPv4 address is looked up in the IPv4 subtree, and the bit it starts at.
ALIASES = (("::ffff:0:0/96", 96), ("2001::/32", 32), ("2002::/16", 16))


def _networks(space: Space, reserved: bool, aliases: bool) -> list[tuple[int, int, str, str]]:
    """(address, depth, kind, text) of the special networks of a space."""
    wide = space.bits == 128
    out = [(n, "an aliased") for n, _ in ALIASES] if wide and aliases else []
    out += [(n, "a reserved") for n in RESERVED_V4 + (RESERVED_V6 if wide else ())] if reserved else []
    nets = [(ipaddress.ip_network(n), kind, n) for n, kind in out]
    return [(int(n.network_address), n.prefixlen + (IPV4_DEPTH if wide and n.version == 4 else 0), kind, text) for n, kind, text in nets]


def special_table(spark: SparkSession, space: Space = V4, reserved: bool = True, aliases: bool = True) -> DataFrame:
    """(s_lo, s_plen, s_kind, conflict): at most 31 rows."""
    rows = [F.struct(space.literal(n).alias("s_lo"), F.lit(d).alias("s_plen"), F.lit(k).alias("s_kind"), F.lit(t).alias("conflict")) for n, d, k, t in _networks(space, reserved, aliases)]
    table = spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.createDataFrame([], "s_plen int, s_kind string, conflict string").withColumn("s_lo", space.literal(0))
    return table


def reserved_rejects(inserts: DataFrame, space: Space = V4, reserved: bool = True, aliases: bool = True) -> DataFrame:
    """Inserts (lo, plen, ...) equal to or inside a special network, with ``conflict``, ``error`` and ``error_class``.

    One broadcast equi-join of a few rows: the insert, masked to each length
    that special networks have, must be one's address. No special network lies
    in another, so an insert has one conflict at most.
    """
    bad = _inside(inserts.select(F.struct("*").alias("_insert"), "lo", "plen"), space, reserved, aliases)
    if space.bits == 32:
        mine = ipv4_prefix_text(F.col("lo"), F.col("plen"))
    else:
        from .lookup import wide_text

        h, l = halves(F.col("lo"))
        in4 = (h == 0) & (F.shiftrightunsigned(l, 32) == 0) & (F.col("plen") >= IPV4_DEPTH)
        mine = F.when(in4, ipv4_prefix_text(l, F.col("plen") - IPV4_DEPTH)).otherwise(wide_text(h, l, F.col("plen")))
    error = F.concat(F.lit("attempt to insert "), mine, F.lit(" into "), "conflict", F.lit(", which is "), "s_kind", F.lit(" network"))
    kind = F.when(F.col("s_kind") == "a reserved", "reserved_network").otherwise("aliased_network")
    return bad.select("_insert.*", "conflict", error.alias("error"), kind.alias("error_class"))


def _inside(inserts: DataFrame, space: Space, reserved: bool, aliases: bool, how: str = "inner") -> DataFrame:
    nets = _networks(space, reserved, aliases)
    lengths = sorted({d for _, d, _, _ in nets})
    special = F.broadcast(special_table(inserts.sparkSession, space, reserved, aliases))
    own = [F.struct(space.mask(F.col("lo"), F.lit(d)).alias("s_lo"), F.lit(d).alias("s_plen")) for d in lengths]
    each = inserts.withColumn("_m", F.explode(F.filter(F.array(*own), lambda x: x["s_plen"] <= F.col("plen")))).select(*inserts.columns, "_m.*")
    return each.join(special, ["s_lo", "s_plen"])


def reserved_accepts(inserts: DataFrame, space: Space = V4, reserved: bool = True, aliases: bool = True) -> DataFrame:
    """Inserts that are not inside a special network: a binary search among constants, without a join."""
    nets = sorted((n, d) for n, d, _, _ in _networks(space, reserved, aliases))

    if not nets:
        return inserts

    def nearest(first: int, last: int) -> Column:
        """Number (from 1) of the last network that starts at or before ``lo``, or 1."""
        if first == last:
            return F.lit(first)
        half = (first + last + 1) // 2
        return F.when(F.col("lo") < space.literal(nets[half - 1][0]), nearest(first, half - 1)).otherwise(nearest(half, last))

    at = nearest(1, len(nets))
    starts = F.array(*[space.literal(n) for n, _ in nets])
    ends = F.array(*[space.literal(n + (1 << (space.bits - d))) for n, d in nets])
    depths = F.array(*[F.lit(d) for _, d in nets])
    net = F.struct(F.element_at(starts, at).alias("lo"), F.element_at(ends, at).alias("hi"), F.element_at(depths, at).alias("plen"))
    kept = inserts.select(F.struct("*").alias("_row"), F.explode(F.array(net)).alias("_net"))  # a generator, so that the search is done once
    inside = (F.col("_row.plen") >= F.col("_net.plen")) & (F.col("_row.lo") >= F.col("_net.lo")) & (F.col("_row.lo") < F.col("_net.hi"))
    return kept.filter(~inside).select("_row.*")


def punch_reserved(ranges: DataFrame, space: Space = V4, reserved: bool = True, aliases: bool = True) -> DataFrame:
    """Ranges (lo, hi, ...) without the special networks they contain: a few constants each, no join."""
    nets = sorted((n, n + (1 << (space.bits - d))) for n, d, _, _ in _networks(space, reserved, aliases))
    free, at = [], 0
    for lo, hi in nets:
        if lo > at:
            free.append((at, lo))
        at = hi
    if at < 1 << space.bits:
        free.append((at, 1 << space.bits))
    parts = [F.struct(F.greatest(F.col("lo"), space.literal(a)).alias("lo"), F.least(F.col("hi"), space.literal(b)).alias("hi")) for a, b in free]
    kept = [c for c in ranges.columns if c not in ("lo", "hi")]
    return ranges.select(*kept, F.explode(F.filter(F.array(*parts), lambda x: x["lo"] < x["hi"])).alias("_x")).select("_x.lo", "_x.hi", *kept)


def tree_cover(ranges: DataFrame, values: list[str], space: Space = V4, reserved: bool = True, aliases: bool = True) -> DataFrame:
    """Canonical records (lo, plen, kind, values) of the whole space as a tree holds it.

    ``kind`` is data, empty, reserved or alias. Special networks punch holes into
    data; equal neighbours are one record, but aliases stay apart, and with them
    no record reaches over the edge of ``::/96``.
    """
    data = punch_reserved(ranges, space, reserved, aliases).select("lo", "hi", *values, F.lit("data").alias("tree_kind"))
    special = special_table(ranges.sparkSession, space, reserved, aliases)
    kind = F.when(F.col("s_kind") == "a reserved", "reserved").otherwise(F.concat(F.lit("alias "), "conflict"))
    special = special.select(F.col("s_lo").alias("lo"), space.end(F.col("s_lo"), F.col("s_plen")).alias("hi"), kind.alias("tree_kind"))
    whole = total_cover(data.unionByName(special, allowMissingColumns=True), ["tree_kind", *values], space)
    kind = F.when(F.col("tree_kind").isNull(), "empty").when(F.col("tree_kind").startswith("alias"), "alias").otherwise(F.col("tree_kind"))
    return to_prefixes(whole.select("lo", "hi", kind.alias("kind"), *values), space, ipv4_apart=space.bits == 128 and aliases)


def embedded_ipv4(hi: Column, lo: Column) -> Column:
    """IPv4 address that an IPv6 address (two unsigned 64-bit halves as BIGINT) is an alias of, else null."""
    u = lambda c, s: F.shiftrightunsigned(c, s)
    low32 = F.lit(0xFFFFFFFF)
    return (
        F.when((hi == 0) & (u(lo, 32) == 0xFFFF), lo.bitwiseAND(low32))
        .when(u(hi, 32) == 0x20010000, hi.bitwiseAND(low32))
        .when(u(hi, 48) == 0x2002, u(hi, 16).bitwiseAND(low32))
    )
