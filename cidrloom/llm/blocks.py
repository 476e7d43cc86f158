"""Documents in blocks, and data that other stages compute for each block.

A block is a row of some texts with their ids. Stages that need an answer from
the whole corpus for each block send arrays keyed by hash bucket instead of
rows, and get arrays back keyed by block. The answers are written beside the
blocks, one file for each file of blocks, and a task that scans a file of
blocks reads the file of answers that belongs to it: texts are never shuffled.

Blocks and buckets both grow with the corpus, so a message for each pair of
them would grow with its square. Messages are sent and answered by groups of
``GROUP`` blocks of a file.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import bounded_batches, filesystem, new_folder, partitions, stash

BLOCK_BYTES = 1 << 20
#: Blocks of a file that share a message to a bucket.
GROUP = 16
_SHIFT = 24
_SCHEMA = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for b in batches:
        ids, texts, size, lo = b.column("doc_id").to_pylist(), b.column("text").to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= BLOCK_BYTES or i + 1 == len(texts):
                row = [pa.array([part << _SHIFT | seq]), pa.array([ids[lo : i + 1]], _SCHEMA.types[1]), pa.array([[x or "" for x in texts[lo : i + 1]]], _SCHEMA.types[2])]
                yield pa.RecordBatch.from_arrays(row, schema=_SCHEMA)
                seq, size, lo = seq + 1, 0, i + 1


def make_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, texts) of all documents, in a table of the shared folder; null texts are empty."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stash(docs.mapInArrow(_pack, "block long, ids array<long>, texts array<string>"), "blocks")


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int | None], pa.Array]]:
    """(block, ids, column of texts)."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.column("block")[i].as_py(), b.column("ids")[i].as_py(), b.column("texts")[i].values.cast(pa.large_string())


def place_in_file(block: int) -> int:
    return block & (1 << _SHIFT) - 1


def group_of(block: int) -> int:
    return block >> _SHIFT << _SHIFT | place_in_file(block) // GROUP


def each_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, list[int | None], pa.Array]]]]:
    """(group, its blocks as ``each_block`` gives them), one block held at a time."""
    return itertools.groupby(each_block(batches), lambda x: group_of(x[0]))


def by_bucket(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Run ``fn(bucket's rows as one table) -> batches`` for each value of ``bucket``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for b in batches:
            lo, buckets = 0, b.column("bucket").to_pylist()
            for i, x in enumerate(buckets):
                if x != at:
                    if i > lo:
                        held.append(b.slice(lo, i - lo))
                    if held:
                        yield from fn(pa.Table.from_batches(held))
                    held, at, lo = [], x, i
            if len(buckets) > lo:
                held.append(b.slice(lo))
        if held:
            yield from fn(pa.Table.from_batches(held))

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def write_side(rows: DataFrame, label: str) -> str:
    """Write (group as ``block``, payload columns) as a file for each file of blocks; returns the folder's URI."""
    spark = rows.sparkSession
    uri = new_folder(spark, label)
    fs, folder = filesystem(uri)
    fs.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(uri)
        sink = temp = out = at = None

        def close() -> None:
            if out is not None:
                out.close()
                sink.close()
                fs.move(temp, f"{folder}/{at}.arrow")

        for b in batches:
            files = b.column("block").to_numpy() >> _SHIFT
            cut = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            for lo, hi in zip(cut, cut[1:]):
                if lo == hi:
                    continue
                if files[lo] != at:
                    close()
                    at, temp = int(files[lo]), f"{folder}/{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(temp)
                    out = pa.ipc.new_file(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(b.slice(lo, hi - lo))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["done"])

    n = partitions(spark)
    file = F.shiftright("block", _SHIFT)
    rows.withColumn("_file", file).repartition(n, "_file").sortWithinPartitions("block").drop("_file").mapInArrow(run, "done long").count()
    return uri


class SideReader:
    """Rows that ``write_side`` wrote for a group, one file held at a time."""

    def __init__(self, uri: str):
        self.fs, self.folder = filesystem(uri)
        self.at, self.rows = None, {}

    def get(self, group: int) -> list[dict]:
        if group >> _SHIFT != self.at:
            self.at, self.rows = group >> _SHIFT, {}
            path = f"{self.folder}/{self.at}.arrow"
            if self.fs.get_file_info(path).type == pa.fs.FileType.File:
                with self.fs.open_input_file(path) as f:
                    table = pa.ipc.open_file(f).read_all()
                for r in table.to_pylist():
                    self.rows.setdefault(r["block"], []).append(r)
        return self.rows.get(group, [])
