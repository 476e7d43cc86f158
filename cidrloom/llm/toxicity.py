"""Operator 1: toxicity by a factorization machine over hashed terms.

Terms are a text's words (letters and digits, ASCII case folded) and the first
four, five and six bytes of longer words, hashed to ``2**BITS`` buckets. Of these, the
buckets whose presence goes with the label (chi-square over the fitting sample),
and those of the ``FREQUENT`` most common ones that do so in pairs though not
alone, carry a weight and a vector of ``RANK`` factors; a text's score is the logistic
of bias, weights and all pairwise products of factors over the distinct chosen
buckets that it holds, so two terms together can say more than the two apart.

The machine is fitted on the driver over a bounded sample of labelled rows, at
most ``MAX_PER_CLASS`` of each label, taken in order of a hash of doc_id. The
model is at most ``MAX_TERMS`` rows, the only thing that is broadcast. Scoring
is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textwords import PUNCT, Words, split_words, text_column
from .workspace import bounded_batches, stash

BITS = 26
RANK = 8
STEMS = (4, 5, 6)
MAX_PER_CLASS = 6000
MAX_TERMS = 20_000
MIN_CHI2 = 8.0
#: Common terms whose pairs are looked at (131,000 pairs), and what a pair needs to be taken.
FREQUENT = 512
MIN_PAIR_CHI2, MIN_PAIR_SEEN = 60.0, 20


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row within the block, bucket) of every term."""
    row = np.repeat(np.arange(words.hi - words.lo), np.diff(words.bounds))
    shift = np.uint64(64 - BITS)
    whole = words.hashes() >> shift
    rows, terms = [row], [whole]
    for n in STEMS:
        long = np.flatnonzero(words.end - words.start > n)
        start = words.start[long]
        rows.append(row[long])
        terms.append((words.hashes(start, start + n) * np.uint64(0x9E3779B97F4A7C15)) >> shift)
    return np.concatenate(rows), np.concatenate(terms).astype(np.int64)


@dataclass
class Model:
    """terms: sorted buckets; w and v: their weights and factors."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def present(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(row, index of term), each pair once, by row."""
        row, bucket = _buckets(words)
        if not len(self.terms):
            return row[:0], row[:0]
        at = np.searchsorted(self.terms, bucket)
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == bucket
        pair = np.unique(row[hit] * len(self.terms) + at[hit])
        return pair // len(self.terms), pair % len(self.terms)

    def scores(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        lin = np.bincount(row, self.w[term], n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            pairs += np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n)
        return 1 / (1 + np.exp(-np.clip(self.bias + lin + 0.5 * pairs, -30, 30)))


def _chi2(seen, hit, n: int, pos: int):
    gap = hit * n - seen * pos
    return gap**2 * n / np.maximum(seen * (n - seen) * pos * (n - pos), 1)


def paired_terms(row: np.ndarray, term: np.ndarray, labels: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Of the terms ``among``, those that together with another one of them go with the label."""
    place = np.full(int(term.max(initial=-1)) + 1, -1)
    place[among] = np.arange(len(among))
    keep = place[term] >= 0
    held = np.zeros((len(labels), len(among)), np.float32)
    held[row[keep], place[term[keep]]] = 1
    toxic = held[labels == 1]
    seen, hit = (held.T @ held).astype(float), (toxic.T @ toxic).astype(float)
    good = (_chi2(seen, hit, len(labels), len(toxic)) >= MIN_PAIR_CHI2) & (seen >= MIN_PAIR_SEEN)
    np.fill_diagonal(good, False)
    return among[good.any(1)]


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 1, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> Model:
    """Factorization machine over the distinct buckets of each row."""
    n, pos = len(rows), int(labels.sum())
    if not pos or pos == n:
        return Model(np.zeros(0, np.int64), -2.0 if not pos else 2.0, np.zeros(0), np.zeros((0, RANK)))
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    bucket = np.concatenate(rows) if row.size else np.zeros(0, np.int64)
    terms, inverse = np.unique(bucket, return_inverse=True)
    seen = np.bincount(inverse, minlength=len(terms)).astype(float)
    seen_pos = np.bincount(inverse, labels[row].astype(float), len(terms))
    chi2 = _chi2(seen, seen_pos, n, pos)
    best = np.argsort(-chi2, kind="stable")[:MAX_TERMS]
    best = best[(chi2[best] >= MIN_CHI2) & (seen[best] >= 2)]
    common = np.argsort(-seen, kind="stable")[:FREQUENT]
    best = np.union1d(best, paired_terms(row, inverse, labels, np.setdiff1d(common, best)))
    index = np.full(len(terms), -1)
    index[best] = np.arange(len(best))
    keep = index[inverse] >= 0
    row, term, m = row[keep], index[inverse][keep], len(best)
    rng = np.random.default_rng(seed)
    # Weights start at half the smoothed log-odds, so that a clear term counts even where it is rare.
    odds = np.log((seen_pos[best] + 0.5) / (pos + 1)) - np.log((seen[best] - seen_pos[best] + 0.5) / (n - pos + 1))
    theta = {"b": np.array([np.log(pos / (n - pos))]), "w": 0.5 * odds, "v": rng.normal(0, 0.02, (m, RANK))}
    first = {k: np.zeros_like(x) for k, x in theta.items()}
    second = {k: np.zeros_like(x) for k, x in theta.items()}
    weight = np.where(labels == 1, 0.5 / pos, 0.5 / (n - pos))
    model = Model(terms[best], 0.0, theta["w"], theta["v"])
    for t in range(1, steps + 1):
        model.bias = float(theta["b"][0])
        err = (model.scores(row, term, n) - labels) * weight
        e = err[row]
        grad = {"b": np.array([err.sum()]), "w": np.bincount(term, e, m) + l2 * theta["w"], "v": np.empty((m, RANK))}
        for f in range(RANK):
            x = theta["v"][term, f]
            total = np.bincount(row, x, n)
            grad["v"][:, f] = np.bincount(term, e * (total[row] - x), m) + l2 * theta["v"][:, f]
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            theta[k] -= rate * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    model.bias = float(theta["b"][0])
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each text."""
    for b in batches:
        size, flat = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
        for words in split_words(text_column(b), True, PUNCT):
            row, bucket = _buckets(words)
            pair = np.unique((row.astype(np.int64) << BITS) | bucket)
            size.append(np.bincount(pair >> BITS, minlength=words.hi - words.lo))
            flat.append((pair & ((1 << BITS) - 1)).astype(np.int32))
        terms = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(size)), pa.int32()), pa.array(np.concatenate(flat)))
        yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), terms], ["toxic", "terms"])


def _only(terms: np.ndarray):
    """Rows cut to the given sorted buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("terms").combine_chunks() if isinstance(b.column("terms"), pa.ChunkedArray) else b.column("terms")
            packed = []
            for x in col:
                v = x.values.to_numpy()
                packed.append(v[np.isin(v, terms)].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(packed, pa.binary())], ["toxic", "terms"])

    return run


def select_terms(rows: DataFrame) -> np.ndarray:
    """Sorted buckets of rows (toxic, terms): at most MAX_TERMS whose presence goes with the label, and the FREQUENT most common."""
    n, pos = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    pos = pos or 0
    each = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("seen"), F.sum("toxic").alias("hit"))
    seen, hit = F.col("seen").cast("double"), F.col("hit").cast("double")
    gap = hit * n - seen * pos
    chi2 = F.try_divide(gap * gap * n, seen * (n - seen) * F.lit(float(pos)) * F.lit(float(n - pos)))
    best = each.withColumn("chi2", chi2).filter((F.col("chi2") >= MIN_CHI2) & (F.col("seen") >= 2)).orderBy(F.desc("chi2"), "term").limit(MAX_TERMS)
    common = each.orderBy(F.desc("seen"), "term").limit(FREQUENT)
    return np.array(sorted(r.term for r in best.select("term").union(common.select("term")).distinct().collect()), np.int64)


def train(docs: DataFrame, labels: DataFrame, fold: int = 5) -> Model:
    """Fit on labelled documents whose crc32(doc_id) mod ``fold`` is not 0.

    Labels other than 0 and 1 and null ids are passed over; of several labels of
    one id the toxic one counts; all rows of a chosen id are learned from, a
    null text as an empty one; without a label of either kind, or documents for
    them, the model holds a bias alone. At most MAX_PER_CLASS ids of each label
    are used, chosen by the hash of the id. Other columns are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    named = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    ids = [
        r
        for y in (0, 1)
        for r in named.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_PER_CLASS).collect()
    ]
    chosen = spark.createDataFrame(ids, "doc_id long, toxic int")
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most two times MAX_PER_CLASS rows
        .mapInArrow(_features, "toxic int, terms array<int>")
    )
    rows = stash(rows, "tox-sample")
    rows = rows.mapInArrow(_only(select_terms(rows)), "toxic int, terms binary").collect()
    rows.sort(key=lambda r: (r.toxic, bytes(r.terms)))  # the order of arrival must not matter
    return fit([np.frombuffer(r.terms, "<i4").astype(np.int64) for r in rows], np.array([r.toxic for r in rows], np.int64))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            out = [
                model.scores(*model.present(words), words.hi - words.lo)
                for words in split_words(text_column(b), True, PUNCT)
            ]
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(b.schema.names, b.columns) if n != "tox_score"), pa.array(score)], [*(n for n in b.schema.names if n != "tox_score"), "tox_score"])

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``tox_score`` (0 to 1; a column of that name is replaced).

    Every whole text is scored; a null or empty one holds no term and gets the
    logistic of the bias. Equal texts get equal scores, an empty table gives an
    empty one, and columns other than ``text`` are carried unread.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "tox_score"]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*docs.schema.fields, StructField("tox_score", DoubleType())])
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), schema)


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    One row a row of ``docs``, repeated or not; a null id is never held out; see
    ``train`` and ``score_toxicity`` for null, empty and repeated texts and for
    tables without rows. Other columns are not looked at.
    """
    model = train(docs, labels, fold)
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False)).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
    )
