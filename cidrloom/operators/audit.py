"""Numbering, dictionaries and invariants of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions.space import V4, Space
from ..plans.tables import settle
from .overlay import exact, total_cover


class LayerInvariantError(ValueError):
    """A layer breaks one of its invariants."""


def nodes(records: DataFrame, space: Space = V4) -> DataFrame:
    """Inner nodes (lo, depth) of the tree whose leaves are the records of a total cover.

    Each is where two neighbours part: the start of every record but the first
    is the middle of exactly one node, whose size the start's lowest bit tells.
    So a node is computed from each record by itself, without a shuffle.
    """
    depth = (F.lit(space.bits - 1) - space.zeros(F.col("lo"))).cast("int")
    inner = records.filter(F.col("lo") != space.literal(0)).select("lo", depth.alias("depth"))
    return inner.select(space.mask(F.col("lo"), F.col("depth")).alias("lo"), "depth")


def node_count(records: DataFrame, space: Space = V4) -> DataFrame:
    """Inner nodes of a total cover: one fewer than its records."""
    return records.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("node_count"))


def numbered_nodes(records: DataFrame, space: Space = V4) -> DataFrame:
    """(lo, depth, node): numbers in the order of the file, counted shard by shard.

    A node precedes everything below it, and shards are in address order, so
    numbers are a running count over the shards, of which there is a fixed
    number, plus the number within the shard.
    """
    n = nodes(records, space).withColumn("_shard", space.shard(F.col("lo")))
    n = n.withColumn("_i", F.row_number().over(Window.partitionBy("_shard").orderBy("lo", "depth")))
    along = Window.partitionBy(F.lit(0)).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    before = n.groupBy("_shard").agg(F.max("_i").cast("long").alias("_n")).select("_shard", F.sum("_n").over(along).alias("_before"))
    before = F.broadcast(before) if space.bits == 32 else before  # at most 65,537 rows
    return n.join(before, "_shard").select("lo", "depth", (F.coalesce("_before", F.lit(0)) + F.col("_i") - 1).alias("node"))


def dictionary(records: DataFrame, value: str) -> DataFrame:
    """(value_key, value, refs): distinct values, equal where their wire form is, with how many records refer to each."""
    kind = records.schema[value].dataType
    each = records.select(F.col(value), exact(F.col(value), kind).alias("_key")).groupBy("_key").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("refs"))
    text = F.to_json(F.struct("_key")) if isinstance(kind, (StructType, ArrayType, MapType)) else F.col("_key").cast("string")
    return each.select(F.sha2(text, 256).alias("value_key"), value, "refs")


def _subtree(value: Column, kind: DataType) -> Column:
    """Array of (type, exact text) of a value and all values in it."""
    name = "map" if isinstance(kind, (StructType, MapType)) else "array" if isinstance(kind, ArrayType) else kind.simpleString()
    text = exact(value, kind)
    text = F.to_json(F.struct(text.alias("x"))) if isinstance(kind, (StructType, ArrayType, MapType)) else text.cast("string")
    parts = [F.array(F.struct(F.lit(name).alias("kind"), text.alias("text")))]
    if isinstance(kind, StructType):
        parts += [_subtree(value[f.name], f.dataType) for f in kind.fields]
    elif isinstance(kind, ArrayType):
        parts.append(F.flatten(F.transform(value, lambda x: _subtree(x, kind.elementType))))
    elif isinstance(kind, MapType):
        parts.append(F.flatten(F.transform(F.map_values(value), lambda x: _subtree(x, kind.valueType))))
    return F.when(value.isNotNull(), F.concat(*[F.coalesce(p, F.expr("array()").cast("array<struct<kind:string,text:string>>")) for p in parts]))


def live_values(records: DataFrame, value: str) -> DataFrame:
    """(live_values): how many different values, nested ones too, the records hold."""
    each = records.select(F.explode(_subtree(F.col(value), records.schema[value].dataType)).alias("x")).distinct()
    return each.agg(F.count(F.lit(1)).alias("live_values"))


def reference_audit(records: DataFrame, values: DataFrame) -> DataFrame:
    """(check, n) of records (value_key) against a dictionary (value_key, refs).

    orphan: keys of records that the dictionary lacks; unused: entries that no
    record refers to; miscounted: entries whose refs differ from the records'.
    """
    used = records.groupBy("value_key").agg(F.count(F.lit(1)).alias("_used"))
    both = used.join(values.select("value_key", "refs"), "value_key", "full_outer")
    counts = both.agg(
        F.count_if(F.col("refs").isNull()).alias("orphan"),
        F.count_if(F.col("_used").isNull()).alias("unused"),
        F.count_if(F.col("refs") != F.col("_used")).alias("miscounted"),
    )
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("orphan", "unused", "miscounted")])).alias("x")).select("x.*")


def violations(records: DataFrame, value: str, space: Space = V4) -> DataFrame:
    """(check, n) of a layer of records (lo, plen, value): the first three are 0 in a sound layer.

    misaligned: records whose address has bits beyond their length; overlap:
    pairs of records of which one holds the other; mergeable: pairs of equal
    buddies; uncovered: maximal ranges without a record, 0 in a total cover.
    """
    r = settle(records.select("lo", "plen", exact(F.col(value), records.schema[value].dataType).alias("v")), "audit")
    base = space.mask(F.col("lo"), F.col("plen"))
    up = space.mask(F.col("lo"), F.col("plen") - 1)
    keys = r.groupBy("lo", "plen", "v").agg(F.count(F.lit(1)).alias("c"))
    first = keys.agg(F.sum(F.when(base != F.col("lo"), F.col("c")).otherwise(0)).alias("n")).select(F.lit("misaligned").alias("check"), F.coalesce("n", F.lit(0)).alias("n"))
    places = r.groupBy("lo", "plen").agg(F.count(F.lit(1)).alias("c"))
    lens = F.broadcast(r.select(F.col("plen").alias("_p")).distinct())  # at most 129 rows
    above = places.join(lens, F.col("_p") < F.col("plen")).select(space.mask(F.col("lo"), F.col("_p")).alias("lo"), F.col("_p").alias("plen"))
    inside = above.join(places, ["lo", "plen"]).agg(F.count(F.lit(1)).alias("n"))
    twice = places.agg(F.count_if(F.col("c") > 1).alias("n"))
    overlap = inside.unionByName(twice).agg(F.sum("n").alias("n")).select(F.lit("overlap").alias("check"), "n")
    buddies = r.filter("plen > 1").groupBy(up.alias("_up"), "plen", "v").agg(F.count(F.lit(1)).alias("c"))
    mergeable = buddies.agg(F.count_if(F.col("c") > 1).alias("n")).select(F.lit("mergeable").alias("check"), "n")
    whole = total_cover(r.select("lo", space.end(F.col("lo"), F.col("plen")).alias("hi"), F.lit(1).alias("x")), ["x"], space)
    uncovered = whole.agg(F.count_if(F.col("kind") == "empty").alias("n")).select(F.lit("uncovered").alias("check"), "n")
    return first.unionByName(overlap).unionByName(mergeable).unionByName(uncovered)


def check_layer(records: DataFrame, value: str, space: Space = V4, total: bool = False) -> None:
    """Raise if an invariant does not hold; ``total`` asks that the whole space is covered."""
    bad = [r for r in violations(records, value, space).filter("n > 0").collect() if total or r.check != "uncovered"]
    if bad:
        raise LayerInvariantError(", ".join(f"{r.check}: {r.n}" for r in bad))
