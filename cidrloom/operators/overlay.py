"""The ordered overlay: an insert log becomes a partition of the address space.

For each address, the inserts that cover it are folded in ``seq`` order. The
plan works on sets: interval ends cut the space into elementary segments; each
segment finds its covering inserts by one equi-join for all prefix lengths
(length, masked address); an aggregation folds; equal neighbours coalesce.

Windows never see the whole space: they run within shards of the leading
address bits, and one row a shard, a fixed number, meets in one place and is
joined back. Both sides of that join read the same exchange, so what comes
before it is computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from ..functions.merge import deep_merge, top_level_merge
from ..functions.space import V4, Space
from .cidr import range_to_prefixes, split_wide

Merge = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Unordered:
    """A merge in which the order of inserts does not matter, as an aggregate that can be taken of its own results.

    Such are ``F.max``, ``F.min``, ``F.sum``, ``F.bit_or``. Nulls take part as the aggregate has it.
    """

    aggregate: Callable[[Column], Column]


def exact(value: Column, kind: DataType) -> Column:
    """A column that is equal just where values have the same wire form: zeros keep their sign, maps have no order."""
    if isinstance(kind, (FloatType, DoubleType)):
        return value.cast("string")
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[exact(value[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: exact(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("k"), exact(e["value"], kind.valueType).alias("v")))
        return F.array_sort(entries)
    return value


def _exact_all(df: DataFrame, values: Sequence[str]) -> Column:
    return F.struct(*[exact(F.col(f"`{v}`"), df.schema[v].dataType).alias(f"k{i}") for i, v in enumerate(values)])


def segments(log: DataFrame, space: Space = V4) -> DataFrame:
    """Elementary segments (lo, hi) between the ends of the log's prefixes (lo, plen)."""
    both = F.explode(F.array(F.col("lo"), space.end(F.col("lo"), F.col("plen"))))
    # the filter is what the join below asks of its left side; said here, both sides read one exchange
    ends = log.select(both.alias("lo")).select(space.shard(F.col("lo")).alias("_shard"), "lo").filter("_shard is not null").distinct().repartition("_shard")
    placed = ends.withColumn("_next", F.lead("lo").over(Window.partitionBy("_shard").orderBy("lo")))
    shards = placed.groupBy("_shard").agg(F.min("lo").alias("_first"))
    after = shards.select("_shard", F.lead("_first").over(Window.partitionBy(F.lit(0)).orderBy("_shard")).alias("_after"))
    return placed.join(_one_a_shard(after, space), "_shard").select("lo", F.coalesce("_next", "_after").alias("hi")).filter("hi is not null")


def _one_a_shard(rows: DataFrame, space: Space) -> DataFrame:
    """A table of at most one row a shard: 65,537 may be broadcast; those of the wide space are left to the engine."""
    return F.broadcast(rows) if space.bits == 32 else rows


def covers(segs: DataFrame, log: DataFrame, lengths: Sequence[int] | None = None, space: Space = V4) -> DataFrame:
    """Each segment (lo, hi) with every log row whose prefix covers it: an equi-join.

    A prefix of length p covers a segment if the segment's start masked to p is
    the prefix's address. There are at most 33 (129) lengths, so that table may
    be broadcast.
    """
    lens = log.select("plen").distinct() if lengths is None else log.sparkSession.createDataFrame([(int(x),) for x in lengths], "plen int")
    return _covers(segs, log, lens, space)


def _covers(segs: DataFrame, log: DataFrame, lens: DataFrame, space: Space) -> DataFrame:
    probe = segs.join(F.broadcast(lens)).withColumn("_base", space.mask(F.col("lo"), F.col("plen")))
    return probe.join(log.withColumnRenamed("lo", "_base"), ["plen", "_base"]).drop("plen", "_base")


def _twice(segs: DataFrame, log: DataFrame, first: Sequence[Column], again: Sequence[Column], space: Space) -> DataFrame:
    """Aggregates over the inserts that cover each segment: ``first`` of those of one prefix, ``again`` of its results.

    A segment meets one row for each length at most, however many inserts a prefix has.
    """
    once = log.groupBy("plen", "lo").agg(*first)
    hits = _covers(segs, once, log.select("plen").distinct(), space)
    return hits.groupBy("lo").agg(F.first("hi").alias("hi"), *again)


def replace_fold(segs: DataFrame, log: DataFrame, values: Sequence[str], space: Space = V4) -> DataFrame:
    """The last covering insert's values; a last insert whose values are all null deletes."""
    first = [F.max_by(F.struct(*values), "seq").alias("_v"), F.max("seq").alias("seq")]
    found = _twice(segs, log, first, [F.max_by("_v", "seq").alias("_v")], space)
    return found.select("lo", "hi", "_v.*").filter(_any_not_null(values))


def unordered_fold(segs: DataFrame, log: DataFrame, value: str, how: Unordered, space: Space = V4) -> DataFrame:
    """The aggregate of all covering inserts' values; a null result is no value."""
    kind = log.schema[value].dataType
    found = _twice(segs, log, [how.aggregate(F.col(value)).alias("_v")], [how.aggregate(F.col("_v")).alias("_v")], space)
    return found.select("lo", "hi", F.col("_v").cast(kind).alias(value)).filter(F.col(value).isNotNull())


def _any_not_null(values: Sequence[str]) -> Column:
    out = F.col(values[0]).isNotNull()
    for v in values[1:]:
        out = out | F.col(v).isNotNull()
    return out


def _last(column: Column, name: str) -> tuple[Column, Column]:
    """The last of a column's values that isn't null and its seq, as a struct, in two steps (see ``_twice``)."""
    first = F.max_by(F.struct("seq", column.alias("v")), F.when(column.isNotNull(), F.col("seq"))).alias(name)
    return first, F.max_by(name, F.col(f"{name}.seq")).alias(name)


def top_level_fold(segs: DataFrame, log: DataFrame, value: str, space: Space = V4) -> DataFrame:
    """Shallow merge of a struct value in seq order: each field's last value that isn't null.

    A null struct deletes what came before it.
    """
    fields = log.schema[value].dataType.names
    lasts = [_last(F.col(value)[f], f"_f{i}") for i, f in enumerate(fields)]
    gone = F.max(F.when(F.col(value).isNull(), F.col("seq"))).alias("_reset")
    first = [gone, F.max("seq").alias("_seq"), *[a for a, _ in lasts]]
    found = _twice(segs, log, first, [F.max("_reset").alias("_reset"), F.max("_seq").alias("_seq"), *[b for _, b in lasts]], space)
    after = lambda seq: F.col("_reset").isNull() | (F.col(seq) > F.col("_reset"))
    merged = [F.when(after(f"_f{i}.seq"), F.col(f"_f{i}.v")).alias(f) for i, f in enumerate(fields)]
    return found.filter(after("_seq")).select("lo", "hi", F.struct(*merged).alias(value))


def deep_fold(segs: DataFrame, log: DataFrame, value: str, space: Space = V4) -> DataFrame:
    """Deep merge of a struct value without arrays and maps in seq order: each leaf's last value that isn't null.

    A struct is there if any insert has it; a null changes nothing.
    """
    first, again = [], []

    def visit(column: Column, kind: DataType) -> Column:
        name = f"_f{len(first)}"
        if not isinstance(kind, StructType):
            a, b = _last(column, name)
            first.append(a)
            again.append(b)
            return F.col(f"{name}.v")
        first.append(F.max(column.isNotNull()).alias(name))
        again.append(F.max(name).alias(name))
        inner = [visit(column[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(F.col(name), F.struct(*inner))

    merged = visit(F.col(value), log.schema[value].dataType)
    return _twice(segs, log, first, again, space).select("lo", "hi", merged.alias(value)).filter(F.col(value).isNotNull())


def ordered_fold(segs: DataFrame, log: DataFrame, value: str, how: str | Merge = "deep", space: Space = V4) -> DataFrame:
    """Merge values in seq order: ``how`` is deep, top_level, or any function of (existing, new) columns.

    A function is called for every covering insert, with null for no value; a
    null result is no value. A null new value deletes under top_level and
    changes nothing under deep. Each segment gathers all inserts that cover it,
    so this grows as segments times inserts over one: see ``fold`` for what doesn't.
    """
    kind = log.schema[value].dataType
    named = {"deep": lambda a, b: deep_merge(a, b, kind), "top_level": lambda a, b: top_level_merge(a, b, kind)}
    merge = (lambda a, b: how(a, b).cast(kind)) if callable(how) else named[how]
    rows = covers(segs, log, space=space).groupBy("lo").agg(F.first("hi").alias("hi"), F.collect_list(F.struct("seq", F.col(value).alias("v"))).alias("_rows"))
    if _has_map(kind):  # maps have no order, so only seq is compared
        ordered = F.array_sort("_rows", lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0))
    else:
        ordered = F.sort_array("_rows")
    folded = F.aggregate(ordered, F.lit(None).cast(kind), lambda acc, r: merge(acc, r["v"]))
    return rows.select("lo", "hi", folded.alias(value)).filter(F.col(value).isNotNull())


def _has_items(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_items(f.dataType) for f in kind.fields)
    return isinstance(kind, (ArrayType, MapType))


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or (isinstance(kind, ArrayType) and _has_map(kind.elementType))


def _runs(rows: DataFrame, values: Sequence[str], space: Space) -> DataFrame:
    """(lo, hi, prev, v, real): starts of maximal runs of touching, equal rows, with the end of the data before.

    A mark at the end of the space closes the last run, and is the only row that isn't real.
    """
    end = rows.sparkSession.range(1).select(space.literal(1 << space.bits).alias("lo"), F.lit(False).alias("real"))
    data = rows.select("lo", "hi", F.struct(*values).alias("v"), _exact_all(rows, values).alias("key"), F.lit(True).alias("real"))
    data = data.unionByName(end, allowMissingColumns=True).withColumn("_shard", space.shard(F.col("lo"))).filter("_shard is not null")
    w = Window.partitionBy("_shard").orderBy("lo")
    placed = data.withColumns({"_hi": F.lag("hi").over(w), "_key": F.lag("key").over(w), "_nth": F.row_number().over(w)})
    inner = (F.col("_nth") > 1) & ~(F.col("real") & (F.col("_hi") == F.col("lo")) & F.col("_key").eqNullSafe(F.col("key")))
    placed = placed.withColumn("_starts", inner)
    ends = placed.groupBy("_shard").agg(
        F.min_by(F.struct("lo", "key", "real"), "lo").alias("first"),
        F.max_by(F.struct("hi", "key"), "lo").alias("last"),
        F.min_by(F.struct("_hi"), F.when(F.col("_starts"), F.col("_nth"))).alias("inner"),
    )
    along = Window.partitionBy(F.lit(0)).orderBy("_shard")
    ends = ends.select("_shard", "first", "inner", F.lag("last").over(along).alias("before"))
    joined = F.col("before").isNotNull() & F.col("first.real") & (F.col("before.hi") == F.col("first.lo")) & F.col("before.key").eqNullSafe(F.col("first.key"))
    ends = ends.withColumn("_joined", joined)
    opening = F.when(~F.col("_joined"), F.struct(F.col("before.hi").alias("_hi"))).otherwise(F.col("inner"))
    later = F.first(opening, ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select("_shard", "_joined", F.col("before.hi").alias("_before"), later["_hi"].alias("_later"))
    starts = placed.join(_one_a_shard(ends, space), "_shard").filter("_starts or (_nth = 1 and not _joined)")
    starts = starts.withColumn("prev", F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("_hi")))
    return starts.select("lo", F.coalesce(F.lead("prev").over(w), "_later").alias("hi"), "prev", "v", "real")


def coalesce_ranges(rows: DataFrame, values: Sequence[str], space: Space = V4) -> DataFrame:
    """Join touching rows (lo, hi, values) of equal values into maximal ranges."""
    return _runs(rows, values, space).filter("real").select("lo", "hi", "v.*")


def total_cover(ranges: DataFrame, values: Sequence[str], space: Space = V4) -> DataFrame:
    """Maximal ranges of the whole space, those without data having null values and ``kind`` empty."""
    none = F.struct(*[F.lit(None).cast(ranges.schema[v].dataType).alias(v) for v in values])
    before = F.coalesce("prev", space.literal(0))
    gap = F.struct(before.alias("lo"), F.col("lo").alias("hi"), F.lit("empty").alias("kind"), none.alias("v"))
    data = F.struct(F.col("lo"), F.col("hi"), F.lit("data").alias("kind"), F.col("v"))
    parts = F.filter(F.array(F.when(before < F.col("lo"), gap), F.when(F.col("real"), data)), lambda x: x.isNotNull())
    return _runs(ranges, values, space).select(F.explode(parts).alias("x")).select("x.lo", "x.hi", "x.kind", "x.v.*")


def fold(log: DataFrame, values: Sequence[str], how: str | Merge | Unordered = "replace", space: Space = V4) -> DataFrame:
    """(lo, hi, values) of each elementary segment that holds data.

    Inserts of one prefix become one row before segments meet them, except
    under functions that say nothing of their order and merges of arrays and maps.
    """
    segs = segments(log, space)
    if how == "replace":
        return replace_fold(segs, log, values, space)
    kind = log.schema[values[0]].dataType
    if how == "top_level" and isinstance(kind, StructType):
        return top_level_fold(segs, log, values[0], space)
    if how == "deep" and isinstance(kind, StructType) and not _has_items(kind):
        return deep_fold(segs, log, values[0], space)
    if isinstance(how, Unordered):
        return unordered_fold(segs, log, values[0], how, space)
    return ordered_fold(segs, log, values[0], how, space)


def overlay(log: DataFrame, values: Sequence[str], how: str | Merge | Unordered = "replace", space: Space = V4, total: bool = False) -> DataFrame:
    """Maximal ranges (lo, hi, values) of the function that the log (seq, lo, plen, values) builds.

    ``how``: replace (a null deletes); or, of one column, top_level, deep, a
    function of (existing, new) columns, or ``Unordered``. ``total`` adds the ranges without data
    (see ``total_cover``), in the same pass.
    """
    rows = fold(log, values, how, space)
    return total_cover(rows, values, space) if total else coalesce_ranges(rows, values, space)


def range_overlay(log: DataFrame, values: Sequence[str], how: str | Merge | Unordered = "replace", space: Space = V4) -> DataFrame:
    """The overlay of inserts of ranges (seq, lo, hi, values), half-open, each taken as its minimal cover."""
    cover = range_to_prefixes(log) if space.bits == 32 else split_wide(log, cap=128)
    return overlay(cover, values, how, space)


def to_prefixes(ranges: DataFrame, space: Space = V4, ipv4_apart: bool = False) -> DataFrame:
    """Canonical records (lo, plen, values): never a record of length 0.

    ``ipv4_apart``: nor one that holds all of ``::/96``, as in trees with aliases.
    """
    return range_to_prefixes(ranges, max_bits=31) if space.bits == 32 else split_wide(ranges, ipv4_apart=ipv4_apart)
