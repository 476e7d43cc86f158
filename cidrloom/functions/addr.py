"""Address arithmetic as column expressions.

IPv4 addresses are BIGINT, so masking and alignment stay in generated code.
IPv6 addresses are BINARY(16), which Spark orders as unsigned bytes; masking
and text go through Arrow functions.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .space import WIDE, wide

SPACE = 1 << 32
ERR_INVALID = "prefix is invalid"
ERR_SHORT_MAPPED = "IPv4-mapped prefixes shorter than /96 cannot be inserted"
ERR_FAMILY = "IPv6 prefixes cannot be inserted into an IPv4 tree"


def power_of_two(exponent: Column) -> Column:
    """2 to an INT exponent, as BIGINT."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), exponent)


def block_size(plen: Column) -> Column:
    """Addresses of an IPv4 prefix of this length."""
    return power_of_two(F.lit(32) - plen)


def mask(ip: Column, plen: Column) -> Column:
    """Network address of the prefix that holds ``ip``."""
    return ip - ip % block_size(plen)


def tree_depth(plen: Column, tree_bits: int = 128) -> Column:
    """Depth of an IPv4 prefix in a tree of 32 or 128 bits."""
    return plen + (tree_bits - 32)


def ipv4_text(ip: Column) -> Column:
    """Dotted text of a BIGINT address."""
    octets = [F.shiftright(ip, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def ipv4_prefix_text(lo: Column, plen: Column) -> Column:
    return F.concat(ipv4_text(lo), F.lit("/"), plen.cast("string"))


def display_prefix(ip: Column, depth: Column) -> Column:
    """Prefix reported for an IPv4 lookup that ended at a tree depth of a 128-bit tree.

    From depth 96 on it has the IPv4 form; above, the IPv6 form with the
    address's leading bits, which are zero.
    """
    short = F.concat(F.lit("::/"), depth.cast("string"))
    plen = depth - 96
    return F.when(depth < 96, short).otherwise(ipv4_prefix_text(mask(ip, F.greatest(plen, F.lit(0))), plen))


def ipv4_from_text(text: Column) -> Column:
    """BIGINT of dotted text; null if it isn't an address."""
    parts = F.split(text, r"\.", -1)
    ok = text.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$")
    nums = [F.try_element_at(parts, F.lit(i)).try_cast("long") for i in (1, 2, 3, 4)]
    value = nums[0] * (1 << 24) + nums[1] * (1 << 16) + nums[2] * (1 << 8) + nums[3]
    return F.when(ok & (F.greatest(*nums) < 256), value)


def _masked(raw: bytes, bits: int) -> bytes:
    return (int.from_bytes(raw, "big") >> (128 - bits) << (128 - bits)).to_bytes(16, "big")


def mask16(ip: Column, bits: Column) -> Column:
    """A 16-byte address cut to its first ``bits`` bits."""

    @pandas_udf("binary")
    def run(ip: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or pd.isna(b) else _masked(a, int(b)) for a, b in zip(ip, bits)])

    return run(ip, bits)


def normalize_one(text: str | None, tree_bits: int) -> tuple[bytes | None, int | None, bool | None, str | None]:
    """(tree-space address, tree depth, IPv4 form, error) of a prefix's text."""
    try:
        if text is None or "/" not in text or "%" in text:
            raise ValueError
        head, _, tail = text.partition("/")
        if not tail.isdigit() or (len(tail) > 1 and tail[0] == "0"):
            raise ValueError
        addr, bits = ipaddress.ip_address(head), int(tail)
        if bits > addr.max_prefixlen:
            raise ValueError
    except ValueError:
        return None, None, None, ERR_INVALID
    if addr.version == 6 and addr.ipv4_mapped is not None:
        if bits < 96:
            return None, None, None, ERR_SHORT_MAPPED
        addr, bits = addr.ipv4_mapped, bits - 96
    if addr.version == 4:
        n = int(addr) >> (32 - bits) << (32 - bits)
        if tree_bits == 32:
            return n.to_bytes(4, "big") + bytes(12), bits, True, None
        return n.to_bytes(16, "big"), bits + 96, True, None
    if tree_bits == 32:
        return None, None, None, ERR_FAMILY
    return _masked(addr.packed, bits), bits, False, None


def normalize_prefix(text: Column, tree_bits: int = 128) -> Column:
    """struct<addr binary, depth int, as4 boolean, error string> of prefix text."""

    @pandas_udf("addr binary, depth int, as4 boolean, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normalize_one(x, tree_bits) for x in s], columns=["addr", "depth", "as4", "error"])

    return run(text)


def wide_prefix(text: Column) -> Column:
    """struct<lo, plen, as4, error> of prefix text in the space of both families (see ``space.V6``)."""

    @pandas_udf("h long, l long, plen int, as4 boolean, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            raw, depth, as4, error = normalize_one(x, 128)
            halves = (None, None) if raw is None else (int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True))
            out.append((*halves, depth, as4, error))
        frame = pd.DataFrame(out, columns=["h", "l", "plen", "as4", "error"])
        return frame.astype({"h": "Int64", "l": "Int64", "plen": "Int32", "as4": "boolean"})

    p = run(text)
    return F.when(p["error"].isNull(), F.struct(wide(p["h"], p["l"]).alias("lo"), p["plen"].alias("plen"), p["as4"].alias("as4"), F.lit(None).cast("string").alias("error"))).otherwise(
        F.struct(F.lit(None).cast(WIDE).alias("lo"), F.lit(None).cast("int").alias("plen"), F.lit(None).cast("boolean").alias("as4"), p["error"].alias("error"))
    )


def prefix_text_one(addr: bytes, depth: int, tree_bits: int, as4: bool) -> str:
    """Text of a tree-space prefix; ``as4`` asks for the IPv4 form."""
    if as4 and tree_bits == 128:
        if depth < 96:
            raise ValueError(f"depth {depth} is not in the IPv4 subtree")
        return f"{ipaddress.IPv4Address(addr[12:])}/{depth - 96}"
    if as4:
        return f"{ipaddress.IPv4Address(addr[:4])}/{depth}"
    return f"{ipaddress.IPv6Address(addr)}/{depth}"


def in_ipv4_subtree(addr: bytes) -> bool:
    return not any(addr[:12])


def shown(addr: bytes, depth: int, tree_bits: int) -> str:
    """Text with the family inferred from where the prefix lies."""
    return prefix_text_one(addr, depth, tree_bits, tree_bits == 32 or (in_ipv4_subtree(addr) and depth >= 96))


def inserted_depth(network: str, tree_bits: int) -> int:
    """Tree depth of an inserted network; 0 if it does not fit the tree."""
    n = ipaddress.ip_network(network)
    if tree_bits not in (32, 128) or (n.version == 6 and tree_bits == 32):
        return 0
    return n.prefixlen + (96 if n.version == 4 and tree_bits == 128 else 0)
