"""Ranges to minimal prefix covers, in closed form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.addr import power_of_two


def range_to_prefixes(ranges: DataFrame, max_bits: int = 32, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Replace half-open ranges ``[lo, hi)`` by the rows of their minimal cover (lo, plen).

    At each block size at most the first and the last aligned block within the
    range can be part of the cover, and one is exactly if its parent block is
    not within the range (or ``max_bits`` caps the size). So a row expands to
    two rows for each size up to its own length, filtered in place: no UDF,
    no shuffle. Rows with ``hi <= lo`` have an empty cover.
    """
    keep = [c for c in ranges.columns if c not in (lo, hi, "plen")]
    a, b, s = F.col(lo), F.col(hi), F.col("_s")
    top = F.least(F.lit(max_bits), F.floor(F.log2(F.greatest(b - a, F.lit(1)).cast("double"))).cast("int"))
    levels = ranges.filter(b > a).withColumn("_k", F.explode(F.sequence(F.lit(0), top))).withColumn("_s", power_of_two(F.col("_k")))
    first = a + F.pmod(-a, s)
    last = b - F.pmod(b, s) - s
    blocks = levels.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    blocks = blocks.withColumn("_c", F.explode(F.array_distinct(F.array("_first", "_last"))))
    parent = F.col("_c") - F.pmod(F.col("_c"), 2 * s)
    outside = (parent < a) | (parent + 2 * s > b)
    out = blocks.filter(outside | (F.col("_k") == max_bits))
    return out.select(*keep, F.col("_c").alias(lo), (F.lit(32) - F.col("_k")).cast("int").alias("plen"))


def _numbers(column: pa.Array) -> list[int]:
    """Addresses of the wide space as numbers."""
    c, h, l = (column.field(i).to_pylist() for i in range(3))
    return [(a << 128) + ((x + (1 << 63)) << 64) + (y + (1 << 63)) for a, x, y in zip(c, h, l)]


def split_wide(ranges: DataFrame, cap: int = 127, ipv4_apart: bool = False) -> DataFrame:
    """``range_to_prefixes`` of the wide space: addresses are structs, lengths up to 128.

    128-bit sizes have no column type, so batches go through Arrow; no shuffle.
    """
    keep = [c for c in ranges.columns if c not in ("lo", "hi", "plen")]
    source = ranges.select("lo", "hi", *keep)
    schema = StructType([*[source.schema[c] for c in keep], StructField("lo", source.schema["lo"].dataType), StructField("plen", IntegerType())])
    biased = lambda x: x - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, h, l, plen = [], [], [], []
            for i, (at, end) in enumerate(zip(_numbers(b.column("lo")), _numbers(b.column("hi")))):
                while at < end:
                    k = min(cap, (at & -at).bit_length() - 1 if at else 128, (end - at).bit_length() - 1)
                    if ipv4_apart and at < 1 << 32:
                        k = min(k, 31)
                    row.append(i)
                    h.append(biased(at >> 64))
                    l.append(biased(at & ((1 << 64) - 1)))
                    plen.append(128 - k)
                    at += 1 << k
            kept = [b.column(c).take(pa.array(row, pa.int64())) for c in keep]
            kind = b.schema.field("lo").type
            lo = pa.StructArray.from_arrays([pa.array([0] * len(row), pa.int32()), pa.array(h, pa.int64()), pa.array(l, pa.int64())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*kept, lo, pa.array(plen, pa.int32())], [*keep, "lo", "plen"])

    return source.mapInArrow(run, schema).select(*keep, "lo", "plen")
