"""Intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from ..plans.tables import shared_dir

BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES``, so that long texts can't fill a worker.

    Spark bounds batches by rows (10,000), which long texts turn into gigabytes.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of a folder of its own below the shared folder."""
    return f"{shared_dir(spark)}/cidrloom-{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Remove the files behind a stashed table that nothing will read again."""
    files = df.inputFiles()
    if files:
        remove(files[0].rsplit("/", 1)[0])


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path within it."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def remove(uri: str) -> None:
    """Delete a folder of the workspace."""
    fs, path = filesystem(uri)
    fs.delete_dir(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which its owner sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
