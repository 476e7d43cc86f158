"""Keep a layer up to date from a stream of inserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.addr import block_size
from ..operators.overlay import overlay

SHARD = 1 << 24


def _shards(log: DataFrame) -> DataFrame:
    last = F.col("lo") + block_size(F.col("plen")) - 1
    return log.withColumn("shard", F.explode(F.sequence(F.floor(F.col("lo") / SHARD), F.floor(last / SHARD))))


def rebuild(spark: SparkSession, log_path: str, layer_path: str, values: Sequence[str], shards: list[int], how: str = "replace") -> None:
    """Fold the log anew for the given /8 shards and replace just those of the layer."""
    log = spark.read.parquet(log_path).filter(F.col("shard").isin(shards))
    each = log.select(F.col("shard").cast("long").alias("shard"), "seq", "lo", "plen", *values)
    start = F.col("shard") * SHARD
    whole = F.col("plen") < 8  # a wider insert is cut to its part of the shard
    cut = each.withColumns({"lo": F.when(whole, start).otherwise(F.col("lo")), "plen": F.when(whole, 8).otherwise(F.col("plen"))}).drop("shard")
    out = overlay(cut, values, how)
    parts = out.withColumn("shard", F.explode(F.sequence(F.floor(F.col("lo") / SHARD), F.floor((F.col("hi") - 1) / SHARD))))
    parts = parts.withColumns({"lo": F.greatest("lo", F.col("shard") * SHARD), "hi": F.least("hi", (F.col("shard") + 1) * SHARD)})
    mark = spark.createDataFrame([(s, s * SHARD) for s in shards], "shard long, lo long").withColumn("hi", F.col("lo"))
    parts = parts.unionByName(mark, allowMissingColumns=True)  # so that a shard left without data is replaced too
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(layer_path)


def read_layer(spark: SparkSession, layer_path: str) -> DataFrame:
    """Ranges (lo, hi, values) of a maintained layer, cut at the shards' edges."""
    return spark.read.parquet(layer_path).filter("hi > lo").drop("shard")


def maintain(inserts: DataFrame, log_path: str, layer_path: str, values: Sequence[str], checkpoint: str, how: str = "replace") -> StreamingQuery:
    """Append a stream (seq, lo, plen, values) to the log and rebuild the shards it touches.

    The log is partitioned by shard, so a rebuild reads the shards it replaces.
    A batch that is repeated after a failure appends under its own batch id
    again, overwriting what it wrote, so every insert counts once.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = _shards(df).withColumn("batch", F.lit(batch_id)).persist()
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard", "batch").parquet(log_path)
        shards = [r.shard for r in rows.select("shard").distinct().collect()]  # at most 256
        rows.unpersist()
        if shards:
            rebuild(spark, log_path, layer_path, values, shards, how)

    return inserts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
