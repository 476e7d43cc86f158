"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import drop_stash, stash

MAX_ROUNDS = 60


def _mins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component: its smallest node.

    Alternates the large-star and small-star steps, which turn any component
    into a star around its smallest node in a number of rounds that grows with
    the logarithm of the size. A step is one aggregation by node (combined
    before its shuffle, so hubs are harmless) and one join, whose hub
    partitions adaptive execution may split. Every round is written to the
    shared folder. Self-links and repeated links do no harm; rows with a null
    are left out; no links give no rows.
    """
    e = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    nodes_alone = e.filter("u = v").select("u", "v")
    e = stash(e.filter("u > v"), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small_m = _mins(large)
        j = large.join(small_m, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_m.select("u", F.col("m").alias("v")))
        new = stash(small.filter("u > v").distinct(), "links")
        r = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stash(e)
        e = new
        if tuple(r) == seen:
            break
        seen = tuple(r)
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = nodes_alone.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(roots).unionByName(alone.join(stars.unionByName(roots), "node", "left_anti"))
