"""Operator 5: exact top-k inner products over norm-sorted, SVD-rotated vectors.

Vectors are quantized to integers, rotated by the right singular vectors of the
whole table (from its d x d Gram matrix, summed over all rows), and written to
the shared folder in descending order of length. Blocks of queries then stream
that table: the inner product over the leading rotated axes plus the product of
the residual lengths bounds every score from above (Cauchy-Schwarz), rows whose
bound is under a query's k-th score are skipped, and a stream ends as soon as
the product of lengths is under every query's k-th score. Scores of what is
left are computed on the integers, so results are exact.

Scale: a task holds one block of queries and one batch of vectors, whatever the
sizes of the two sets; nothing is broadcast but the d x d rotation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import filesystem, new_folder, partitions, stash

QUERY_BLOCK = 512
VECTOR_BATCH = 8192
SCALE = 64.0
#: Sums of products stay exact in doubles below this bound; beyond it Python integers are used.
EXACT = 2.0**52
_LONG = (1 << 63) - 1


def _quantized(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
        if i is None or not v.is_valid:
            continue
        x = np.array([np.nan if c is None else c for c in v.as_py()] if v.values.null_count else v.values.to_numpy(zero_copy_only=False), np.float64)
        if np.isfinite(x).all():
            yield i, np.floor(x * SCALE)


def _quantize(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, norms = [], [], []
            for i, q in _quantized(b):
                full = np.zeros(dim)
                full[: len(q)] = q
                ids.append(i)
                rows.append(full.tobytes())
                norms.append(float(np.sqrt((full * full).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "q", "norm"])

    return run


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dim)


def _gram(dim: int, rows: bool):
    """Sums of q q' of vectors (``rows``) or of such sums, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                if rows:
                    m = _matrix(b.column(0), dim)
                    total += m.T @ m
                else:
                    total += _matrix(b.column(0), dim * dim).sum(0).reshape(dim, dim)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])

    return run


def _search(uri: str, dim: int, rotation: np.ndarray, lead: int, k: int):
    def run(queries: pd.DataFrame) -> pd.DataFrame:
        fs, path = filesystem(uri)
        files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(path)) if f.path.endswith(".parquet"))
        q = np.frombuffer(b"".join(queries["q"]), np.float64).reshape(-1, dim)
        own, qnorm = queries["row"].to_numpy(), queries["norm"].to_numpy()
        qr = q @ rotation
        qlead, qrest = qr[:, :lead], np.sqrt(np.maximum((qr[:, lead:] ** 2).sum(1), 0))
        n = len(q)
        top_s: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        top_i: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        floor = np.full(n, -np.inf)
        for batch in ds.dataset(files, filesystem=fs, format="parquet").to_batches(batch_size=VECTOR_BATCH, columns=["vec_id", "row", "norm", "q"], fragment_readahead=1, batch_readahead=1):
            if not batch.num_rows:
                continue
            norm = batch.column("norm").to_numpy()
            slack = 1e-6 * (1 + qnorm * norm[0])
            live = np.flatnonzero(qnorm * norm[0] + slack >= floor)
            if not len(live):
                break  # lengths only get smaller from here on
            v = _matrix(batch.column("q"), dim)
            ids, rows = batch.column("vec_id").to_numpy(), batch.column("row").to_numpy()
            vr = v @ rotation
            vrest = np.sqrt(np.maximum((vr[:, lead:] ** 2).sum(1), 0))
            bound = qlead[live] @ vr[:, :lead].T + np.outer(qrest[live], vrest)
            maybe = bound + slack[live][:, None] >= floor[live][:, None]
            exact = float(qnorm[live].max()) * float(norm[0]) < EXACT
            whole = q[live] @ v.T if exact and maybe.mean() > 0.05 else None
            for j, at in enumerate(live):
                hit = np.flatnonzero(maybe[j] & (rows != own[at]))
                if not len(hit):
                    continue
                if whole is not None:
                    s = whole[j, hit].astype(np.int64)
                elif exact:
                    s = (v[hit] @ q[at]).astype(np.int64)
                else:
                    big = [sum(int(a) * int(b) for a, b in zip(x, q[at])) for x in v[hit]]
                    s = np.array([max(-_LONG - 1, min(_LONG, b)) for b in big], np.int64)
                s, i = np.concatenate([top_s[at], s]), np.concatenate([top_i[at], ids[hit]])
                if len(s) > 4 * k:  # keep all ties with the k-th before the exact order
                    kth = np.partition(s, len(s) - k)[len(s) - k]
                    s, i = s[s >= kth], i[s >= kth]
                order = np.lexsort((i, -s.astype(np.float64) if exact else [-int(x) for x in s]))[:k]
                top_s[at], top_i[at] = s[order], i[order]
                if len(order) == k:
                    floor[at] = float(s[order[-1]])
        counts = [len(s) for s in top_s]
        return pd.DataFrame(
            {
                "query_id": np.repeat(queries["vec_id"].to_numpy(), counts),
                "rank": np.concatenate([np.arange(1, c + 1) for c in counts]).astype(np.int32),
                "vec_id": np.concatenate(top_i),
                "score": np.concatenate(top_s),
            }
        )

    return run


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, lead: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    ``vectors``: vec_id, embedding. Queries are the rows whose vec_id is
    divisible by ``query_every``; candidates are all rows but the query's own.
    Components become floor(64 x); ties go to the smaller vec_id. Rows with a
    null id, a null vector or a null or non-finite component take no part;
    shorter vectors are padded with zeros (an empty one is all zeros); a
    repeated row is a candidate for its twin and a query of its own; an empty
    table gives no rows; scores beyond a long are cut to its range; other
    columns are not looked at. ``lead``: leading rotated axes of the first
    bound (a quarter of the dimension if None).
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0]
    dim = max(1, dim or 0)
    rows = stash(vectors.mapInArrow(_quantize(dim), "vec_id long, q binary, norm double"), "topk-q")
    gram = rows.select("q").mapInArrow(_gram(dim, True), "gram binary").repartition(8).mapInArrow(_gram(dim, False), "gram binary")
    total = sum((np.frombuffer(r.gram, np.float64).reshape(dim, dim) for r in gram.toLocalIterator()), np.zeros((dim, dim)))
    scale = float(np.abs(total).max()) or 1.0
    rotation = np.linalg.eigh(total / scale)[1][:, ::-1].copy()
    uri = new_folder(spark, "topk-sorted")
    (
        rows.repartitionByRange(partitions(spark), F.desc("norm"), "vec_id")
        .sortWithinPartitions(F.desc("norm"), "vec_id")
        .withColumn("row", F.monotonically_increasing_id())
        .write.option("compression", "zstd")
        .parquet(uri)
    )
    ordered = spark.read.schema("vec_id long, q binary, norm double, row long").parquet(uri)
    queries = ordered.filter(F.col("vec_id") % query_every == 0)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    # a set number of partitions, or small blocks would be put together into one task
    placed = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).repartition(2 * blocks, "block")
    return placed.groupBy("block").applyInPandas(
        _search(uri, dim, rotation, lead or max(1, dim // 4), k), "query_id long, rank int, vec_id long, score long"
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS q, row_number() OVER () AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, a.r, b.vec_id, list_sum([z[1] * z[2] for z in list_zip(a.q, b.q)])::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
