"""Operator 8: benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set (classes a quarter
wide). For a containment of t in a class of sizes up to u, at most
``floor((1 - t) u)`` shingles may be missing, so of any ``that + 1`` one is in
the document. A class's items are indexed by that many minimum hashes. Every
shingle of a document is hashed by the same function and looked up, which finds
every item that is contained, however long the document is (banded signatures
of a whole document would miss short items: their Jaccard similarity is tiny).
Candidates are confirmed by exact containment of their shingles as words.

Scale: one pass over the documents without a shuffle for each block of items; a
block holds at most ``BLOCK_ITEMS`` items or ``BLOCK_CHARS`` characters (a
longer item alone), so what is broadcast is bounded; ``CHAIN`` blocks at a time
go over the texts.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .neardup import doc_shingles, shingle_set
from .textwords import mix64, shingle_hashes, split_words, text_column
from .workspace import bounded_batches, stash

BLOCK_ITEMS = 20_000
BLOCK_CHARS = 16_000_000
#: Blocks of items that a task has in Python at once.
CHAIN = 4
FOUND = ArrayType(StructType([StructField("item_id", LongType()), StructField("n_shared", LongType()), StructField("n_item", LongType())]))
_FOUND_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())]))


def _class_bound(size: int) -> int:
    """Upper size of the class that holds ``size``."""
    bound = 1
    while bound < size:
        bound = max(bound + 1, bound * 5 // 4)
    return bound


class ItemIndex:
    """Minimum-hash index of one block of items."""

    def __init__(self, items: list[tuple[int, str]], k: int, percent: int):
        self.k, self.percent, self.items = k, percent, []
        hashes, owners = [], []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            sh = shingle_set(text, k)
            if not sh:
                continue
            at = len(self.items)
            self.items.append((item_id, sh))
            words = next(iter(split_words(pa.array([text], pa.large_string()), True)))
            h = np.unique(doc_shingles(words, k)[1])
            m = len(words.start)
            if m < k:
                self.short[m][int(h[0])].append(at)
                continue
            keep = (100 - percent) * _class_bound(len(sh)) // 100 + 1
            h = np.sort(h)[:keep]
            hashes.append(h)
            owners.append(np.full(len(h), at))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners = h[order], o[order]
        self.short = {m: dict(x) for m, x in self.short.items()}

    def bitmap(self) -> np.ndarray:
        bits = np.zeros(1 << 22, bool)
        bits[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        return bits

    def candidates(self, words, bits: np.ndarray) -> dict[int, set[int]]:
        """Row of the block -> items that share an indexed shingle."""
        found: dict[int, set[int]] = defaultdict(set)
        row, h = doc_shingles(words, self.k)
        hit = np.flatnonzero(bits[(h >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, h[hit], "left"), np.searchsorted(self.hashes, h[hit], "right")
        for r, x, y in zip(row[hit[hi > lo]], lo[hi > lo], hi[hi > lo]):
            found[int(r)].update(self.owners[x:y].tolist())
        for m, table in self.short.items():
            word = words.hashes()
            v = np.full(max(0, len(word) - m + 1), m, np.uint64)
            for j in range(m):
                v = v * np.uint64(0xD6E8FEB86659FD93) + word[j : j + len(v)]
            v = mix64(v)
            at = np.flatnonzero(np.isin(v, np.array(list(table), np.uint64)))
            rows = np.searchsorted(words.bounds, at, "right") - 1
            for i, r in zip(at, rows):
                if i + m <= words.bounds[r + 1]:
                    found[int(r)].update(table[int(v[i])])
        return found

    def confirm(self, text: str, items: set[int]) -> list[dict]:
        mine, out = shingle_set(text, self.k), []
        runs: dict[int, set] = {}
        for i in sorted(items):
            item_id, sh = self.items[i]
            m = len(next(iter(sh)))
            if m < self.k:
                if m not in runs:
                    w = next(iter(mine)) if len(mine) == 1 else None
                    seq = list(w) if w and len(w) < self.k else _words(text)
                    runs[m] = set(zip(*(seq[j:] for j in range(m))))
                shared = len(sh & runs[m])
            else:
                shared = len(sh & mine)
            if 100 * shared >= self.percent * len(sh):
                out.append({"item_id": item_id, "n_shared": shared, "n_item": len(sh)})
        return out


def _words(text: str) -> list[bytes]:
    return text.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()


def _mark(shared, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        bits = index.bitmap()
        for b in batches:
            col = text_column(b)
            found = [[] for _ in range(b.num_rows)]
            for words in split_words(col, True):
                for r, items in index.candidates(words, bits).items():
                    found[words.lo + r] = index.confirm(col[words.lo + r].as_py(), items)
            if column in b.schema.names:  # found by an earlier block
                found = [x + y for x, y in zip(b.column(column).to_pylist(), found)]
            names = [n for n in b.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found, _FOUND_ARROW)], [*names, column])

    return run


def mark_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, column: str = "found_items") -> DataFrame:
    """``docs`` with an array of the items (item_id, n_shared, n_item) that each contains.

    An item is contained if ``percent`` of its distinct k-word shingles (ASCII
    case folded) are in the document; one of fewer than k words if its words
    occur there in a row. Null or empty items are in no document; null or empty
    documents contain none; repeated items and rows count each for itself; an
    empty table on either side gives empty arrays or no rows; a column of the
    name ``column`` is replaced, all others are carried unread.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, chars, longest = items.agg(F.count(F.lit(1)), F.sum(F.length("text")), F.max(F.length("text"))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-(chars or 0) // BLOCK_CHARS))
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])

    def chain(out: DataFrame, which: range) -> DataFrame:
        schema = StructType([*out.schema.fields, StructField(column, FOUND)])
        for i in which:
            rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()
            index = ItemIndex([(r.item_id, r.text) for r in rows], k, percent)
            out = out.mapInArrow(_mark(spark.sparkContext.broadcast(index), column), schema)
        return out

    if blocks <= CHAIN:
        return chain(docs, range(blocks))
    # Many blocks: texts go through a few at a time, and what was found is written in between.
    numbered = stash(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "numbered")
    texts, parts = numbered.select("at", F.col("row.text").alias("text")), []
    for lo in range(0, blocks, CHAIN):
        found = chain(texts, range(lo, min(lo + CHAIN, blocks))).filter(F.size(f"`{column}`") > 0)
        parts.append(stash(found.select("at", F.col(f"`{column}`").alias("found")), "found"))
    every = functools.reduce(DataFrame.unionByName, parts).groupBy("at").agg(F.flatten(F.collect_list("found")).alias("found"))
    whole = numbered.join(every, "at", "left")
    return whole.select("row.*", F.coalesce("found", F.array().cast(FOUND)).alias(column))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): one row for each item in each document; see ``mark_contaminated``."""
    marked = mark_contaminated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), items, k, percent)
    return marked.select("doc_id", F.explode("found_items").alias("x")).select("doc_id", "x.item_id", "x.n_shared", "x.n_item")


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that contain no item, with all their columns.

    Rows and items are taken as in ``mark_contaminated``: a null or empty text
    stays, repeated rows are judged each for itself, and with no items all stay.
    """
    name = "_found"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return mark_contaminated(docs, items, k, percent, name).filter(F.size(name) == 0).drop(name)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
ish AS (SELECT DISTINCT r, item_id, least(len(ws), 5) AS m, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[j:j + 4], ' ') for j in range(1, len(ws) - 3)] END) AS sh FROM i WHERE len(ws) > 0),
dsh AS (SELECT DISTINCT r, doc_id, m, unnest([array_to_string(ws[j:j + m - 1], ' ') for j in range(1, len(ws) - m + 2)]) AS sh FROM d, (SELECT DISTINCT m FROM ish) WHERE len(ws) >= m),
n AS (SELECT r, count(*) AS n_item FROM ish GROUP BY r)
SELECT dsh.doc_id, ish.item_id, count(*) AS n_shared, any_value(n.n_item) AS n_item
FROM ish JOIN dsh USING (m, sh) JOIN n ON n.r = ish.r GROUP BY dsh.r, dsh.doc_id, ish.r, ish.item_id
HAVING 100 * count(*) >= 80 * any_value(n.n_item)
"""
