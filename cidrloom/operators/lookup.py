"""Point lookups: which record holds an address."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructType

from ..functions.addr import ipv4_prefix_text
from ..functions.space import IPV4_DEPTH, V4, V6, Space, halves, wide
from .special import embedded_ipv4

#: Probes of one shard that a task takes; a shard with more is split, with its records in each part,
#: into parts of as many probes as it has records at least, so that these copies are no more than the probes.
HOT_PROBES = 250_000


def lookup(probes: DataFrame, records: DataFrame, ip: str = "ip", how: str = "inner", splits: int | None = None, space: Space = V4) -> DataFrame:
    """Probes with the record (lo, plen, values) that holds their address.

    Records are disjoint, so the one that starts last at or before an address is
    the only candidate: a merge of both tables in address order within shards
    of the leading address bits, each with the last record of the shards before
    as its first row; nothing is sent again by shard alone, which would undo the splits. With ``how`` left, probes without a record
    keep nulls, and so do null addresses. ``splits`` spreads each shard's probes
    over so many tasks, with its records in each; by default that is done, by
    count, for shards of more than ``HOT_PROBES`` probes.
    """
    values = [c for c in records.columns if c not in ("lo", "plen")]
    rec = F.struct("lo", "plen", F.struct(*values).alias("v")).alias("_rec")
    r = records.select(space.shard(F.col("lo")).alias("_shard"), F.col("lo").alias("_at"), F.lit(0).alias("_kind"), rec)
    row = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    p = probes.select(row.alias("_row"), F.col(f"`{ip}`").alias("_at"), F.lit(1).alias("_kind"))
    if space.bits == 32:
        p = p.withColumn("_at", F.col("_at").cast("long"))
    p = p.withColumn("_shard", F.coalesce(space.shard(F.col("_at")), F.lit(-1)))
    part = F.pmod(F.xxhash64("_row"), F.col("_n")).cast("int").alias("_split")
    # the filters ask for every column, so that all readers of these two tables read one exchange
    shards = r.groupBy("_shard").agg(F.max_by("_rec", "_at").alias("_last"), F.count(F.lit(1)).alias("_r")).filter("_last is not null and _r > 0")
    probed = p.groupBy("_shard").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 0")
    along = Window.partitionBy(F.lit(0)).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    wanted = shards.select("_shard", "_last").unionByName(probed.select("_shard"), allowMissingColumns=True).groupBy("_shard").agg(F.first("_last", ignorenulls=True).alias("_last"))
    before = wanted.select("_shard", F.last("_last", ignorenulls=True).over(along).alias("_rec")).filter("_rec is not null")
    r = r.unionByName(before.select("_shard", F.col("_rec.lo").alias("_at"), F.lit(0).alias("_kind"), "_rec"))
    if splits is None:
        hot = probed.filter(F.col("_c") > HOT_PROBES).join(shards.select("_shard", "_r"), "_shard", "left")
        hot = hot.select("_shard", F.ceil(F.col("_c") / F.greatest(F.lit(HOT_PROBES), F.coalesce("_r", F.lit(0)))).cast("int").alias("_n"))
        hot = F.broadcast(hot)  # a row for every HOT_PROBES probes at most
        r, p = (x.join(hot, "_shard", "left").withColumn("_n", F.coalesce("_n", F.lit(1))) for x in (r, p))
    else:
        r, p = (x.withColumn("_n", F.lit(splits)) for x in (r, p))
    p = p.select("_shard", "_at", "_kind", "_row", part)
    r = r.select("_shard", "_at", "_kind", "_rec", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_split"))
    both = r.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy("_shard", "_split").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_rec", F.last("_rec", ignorenulls=True).over(w)).filter("_kind = 1")
    holds = space.end(F.col("_rec.lo"), F.col("_rec.plen")) > F.col("_at")
    if how == "inner":
        found = found.filter(holds)
    else:
        found = found.withColumn("_rec", F.when(holds, F.col("_rec")))
    return found.select("_row.*", "_rec.lo", "_rec.plen", "_rec.v.*")


@pandas_udf(StructType().add("ok", "boolean").add("as4", "boolean").add("h", "long").add("l", "long"))
def parse_address(text: pd.Series) -> pd.DataFrame:
    """An address's text: IPv4-mapped ones count as IPv4; halves are unsigned."""
    out = []
    for t in text:
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            out.append((False, False, 0, 0))
            continue
        if a.version == 6 and (a.scope_id is not None):
            out.append((False, False, 0, 0))
            continue
        if a.version == 6 and a.ipv4_mapped is not None:
            a = a.ipv4_mapped
        n = int(a)
        out.append((True, a.version == 4, *(x - (1 << 64) if x >> 63 else x for x in (n >> 64, n & ((1 << 64) - 1)))))
    return pd.DataFrame(out, columns=["ok", "as4", "h", "l"])


@pandas_udf(StringType())
def wide_text(h: pd.Series, l: pd.Series, plen: pd.Series) -> pd.Series:
    """Text of the IPv6 prefix of this length that holds an address of unsigned halves."""
    m = (1 << 64) - 1
    return pd.Series([None if pd.isna(p) else str(ipaddress.ip_network(((int(a) & m) << 64 | (int(b) & m), int(p)), strict=False)) for a, b, p in zip(h, l, plen)])


def get(probes: DataFrame, records: DataFrame, ip: str = "ip", space: Space = V6, aliases: bool = True) -> DataFrame:
    """Probes (``ip``: text) with ``network`` and the values of the record of a total cover that holds them.

    ``records`` (lo, plen, values) cover the space, so that a miss has a network
    too, and null values. An address that isn't one, or an IPv6 address in a
    space of 32 bits, has neither. An IPv4 address, mapped or not, sees records
    in IPv4 form from depth 96 on; with ``aliases`` an address in an aliased
    network (6to4, Teredo) is looked up as the IPv4 address in it, and the
    prefix is reported as seen from the address.
    """
    a = parse_address(F.col(f"`{ip}`").cast("string"))
    p = probes.select(F.struct(*[F.col(f"`{c}`") for c in probes.columns]).alias("_probe"), a.alias("_a"))
    h, l = F.col("_a.h"), F.col("_a.l")
    inner = embedded_ipv4(h, l) if aliases and space.bits == 128 else F.lit(None).cast("long")
    p = p.withColumn("_inner", F.when(~F.col("_a.as4"), inner))
    # bits of the address before the embedded one
    p = p.withColumn("_skip", F.when(F.col("_inner").isNull(), 0).when(F.shiftrightunsigned(h, 48) == 0x2002, 16).otherwise(32))
    if space.bits == 32:
        p = p.withColumn("_at", F.when(F.col("_a.ok") & F.col("_a.as4"), l))
    else:
        p = p.withColumn("_at", F.when(F.col("_a.ok"), F.when(F.col("_inner").isNotNull(), wide(F.lit(0).cast("long"), F.col("_inner"))).otherwise(wide(h, l))))
    values = [c for c in records.columns if c not in ("lo", "plen")]
    found = lookup(p, records.select("lo", "plen", F.struct(*values).alias("_v")), "_at", "left", space=space)
    depth = F.when(F.col("_inner").isNotNull(), F.col("plen") - IPV4_DEPTH + F.col("_skip")).otherwise(F.col("plen"))
    short = F.col("_a.as4") & (F.lit(space.bits == 32) | (F.col("plen") >= IPV4_DEPTH))
    four = F.col("plen") - (0 if space.bits == 32 else IPV4_DEPTH)
    masked = V4.mask(F.col("_a.l"), F.greatest(four, F.lit(0)))
    text = F.when(short, ipv4_prefix_text(masked, four)).otherwise(wide_text(F.col("_a.h"), F.col("_a.l"), depth))
    return found.select("_probe.*", text.alias("network"), *[F.col(f"_v.`{v}`").alias(v) for v in values])
