"""Operator 9: near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's distinct k-word shingles give ``CHUNKS * WIDTH`` minimum hashes,
cut to 16 bits each. Two signatures that differ in at most ``MAX_DISTANCE``
places differ, by the pigeonhole principle, in at most ``ERRORS`` places of
some chunk. So each chunk is stored once for every choice of ``ERRORS`` places
left out, and any such pair meets under one of these keys: none under the
distance is missed. Beyond it (at a similarity of 0.85 (0.8) with probability
2.3e-6 (3.0e-4)) most pairs share a key too: at 0.85 (0.8) none is shared with
probability 4e-10 (1e-7). Every pair that shares a key and is not yet joined is
confirmed, whatever its distance, unless it can't be a link: a sketch also
counts the distinct shingles whose hashes lie in each of ``RANGES`` ranges. Two
sets differ in at least as many shingles as these counts do, and those of a link
differ in at most (100 - percent) / (100 + percent) of their sizes' sum. So
documents that share a template, but too little to be linked, cost a comparison
of counts instead of their texts, and no link is lost by it.

Links are confirmed on the full sets of shingles, as words. Documents of equal
sets are one node from the start. Each key first links its members to its
smallest one only; what these links join need not be compared further, and
pairs of different components that still share a key are confirmed one by one,
so no link between components is lost and dense groups cost one link a member.

Scale: one shuffle of the keys, combined by batch, and two of the texts that
have a candidate; members of a key meet in arrays, spread over tasks from ``KEY_BLOCK`` members on; stars are salted in blocks of ``STAR_BLOCK`` members with the centre
repeated, so a group of any size is spread over tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .textwords import mix64, shingle_hashes, split_words, text_column
from .workspace import bounded_batches, partitions, stash

CHUNKS, WIDTH, ERRORS = 12, 5, 1
SIZE = CHUNKS * WIDTH
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
STAR_BLOCK = 2048
RANGES = 128
KEY_BLOCK = 8192
#: Pairs whose counts are compared at once.
PAIRS = 1 << 16
#: Ids that may be broadcast to pick the texts to compare (8 bytes each); beyond it they are joined.
MAX_BROADCAST_NODES = 1_000_000

_rng = np.random.default_rng(9)
_MULT = _rng.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, SIZE, dtype=np.uint64)


def doc_shingles(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the shingles of a block, by row; fewer than k words: the sequence as one."""
    n = np.diff(words.bounds)
    h = words.hashes()
    row = np.repeat(np.arange(len(n)), n)
    s = shingle_hashes(h, k)
    at = np.arange(len(s))
    whole = at + k <= words.bounds[1:][row[: len(s)]] if len(s) else np.zeros(0, bool)
    rows, hashes = [row[: len(s)][whole]], [s[whole]]
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            at = words.bounds[short]
            v = np.full(len(short), m, np.uint64)
            for j in range(m):
                v = v * np.uint64(0xD6E8FEB86659FD93) + h[at + j]
            rows.append(short)
            hashes.append(mix64(v))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    if len(n) and (n < k).any():
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    return rows, hashes


def _sketch(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, h1, h2, sigs, ranges = [], [], [], [], []
            for words in split_words(text_column(b), True):
                docs = words.hi - words.lo
                row, h = doc_shingles(words, k)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                row, h = row[new], h[new]
                n = np.bincount(row, minlength=docs)
                has = np.flatnonzero(n)
                first = np.concatenate([[0], np.cumsum(n)])[has]
                sums = np.zeros((2, docs), np.uint64)
                sig = np.zeros((docs, SIZE), np.uint16)
                if len(has):
                    sums[0, has] = np.add.reduceat(mix64(h), first)
                    sums[1, has] = np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), first)
                    for j in range(SIZE):
                        sig[has, j] = mix64(np.minimum.reduceat((h ^ _FLIP[j]) * _MULT[j], first)).astype(np.uint16)
                count.append(n)
                h1.append(sums[0].view(np.int64))
                h2.append(sums[1].view(np.int64))
                sigs += [s.tobytes() for s in sig]
                # modulo 256; differences are taken around the circle, so they are never too large
                counts = np.bincount(row * RANGES + (h >> np.uint64(57)).astype(np.int64), minlength=docs * RANGES).astype(np.uint8)
                ranges += [c.tobytes() for c in counts.reshape(docs, RANGES)]
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cat(count), pa.int64()), pa.array(cat(h1)), pa.array(cat(h2)), pa.array(sigs, pa.binary()), pa.array(ranges, pa.binary())], schema=schema
            )

    return run


_ROW = pa.schema([("key", pa.int64()), ("hub", pa.int64()), ("node", pa.int64())])


def _index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hub, node) for every chunk and choice of places left out.

    Combined by batch: the batch's smallest node under a key has no hub, the
    others have that node as theirs and need not be sent to the key's group.
    """
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        node = b.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        node, sig = node[order], sig[order]
        for c in range(CHUNKS):
            for v, gone in enumerate(itertools.combinations(range(WIDTH), ERRORS)):
                key = np.full(len(sig), c * 64 + v + 1, np.uint64)
                for p in range(WIDTH):
                    if p not in gone:
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, c, p])
                u, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                hub = node[first][inverse]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(hub, mask=hub == node), pa.array(node)], schema=_ROW)


def _group_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, node): each but the first of a key, with that one as its hub."""
    at_key, at_node = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        key, node = b.column("key").to_numpy(), b.column("node").to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = key[0] != at_key
        start = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        hub = np.where(which < 0, at_node, node[start[np.maximum(which, 0)]] if len(start) else at_node)
        at_key, at_node = key[-1], hub[-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[~new]), pa.array(hub[~new]), pa.array(node[~new])], schema=_ROW)


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with counts ``a`` and ``b`` (rows of bytes) and sizes of sum ``n`` can be alike enough."""
    apart = a - b
    apart = np.minimum(apart, np.negative(apart)).astype(np.float32) @ np.ones(RANGES, np.float32)
    return apart.astype(np.int64) * (100 + percent) <= n * (100 - percent)


def _counts(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, RANGES)


def _possible(percent: int):
    """Of pairs (a, b) with their sizes and counts, those that may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n = t.column("na").to_numpy() + t.column("nb").to_numpy()
            ok = pa.array(may_link(_counts(t.column("ca")), _counts(t.column("cb")), n, percent))
            yield t.select(["a", "b"]).filter(ok)

    return run


def _across(percent: int):
    """Pairs of one key and different components that may be links; rows in order of (key, salt, n)."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, salt, n, node, comp, own = (t.column(c).to_numpy() for c in ("key", "salt", "n", "node", "comp", "own"))
        counts, new = _counts(t.column("counts")), np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        group = (np.cumsum(new) - 1) << 40
        # the smaller of a link has at least percent of the larger's shingles
        last = np.searchsorted(group + n, group + (100 * n // percent if percent else (1 << 40) - 1), "right")
        size = last - np.arange(len(key)) - 1
        ends = np.cumsum(size)
        for lo in range(0, int(ends[-1]), PAIRS):
            at = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
            i = np.searchsorted(ends, at, "right")
            j = i + 1 + at - (ends[i] - size[i])
            i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
            use = (comp[i] != comp[j]) & own[i]
            i, j = i[use], j[use]
            use = may_link(counts[i], counts[j], n[i] + n[j], percent)
            if use.any():
                ab = np.unique(np.stack([node[i[use]], node[j[use]]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            now = pa.concat_tables([held, now]).combine_chunks() if held is not None else now
            key, salt = now.column("key").to_numpy(), now.column("salt").to_numpy()
            cut = int(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))[-1])
            if cut:
                yield from pairs(now.slice(0, cut))
            held = now.slice(cut)
        if held is not None:
            yield from pairs(held)

    return run


def shingle_set(text: str | None, k: int) -> set:
    """Distinct shingles as tuples of words."""
    raw = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    w = raw.split()  # on bytes: exactly the ASCII space and 9 to 13
    if len(w) < k:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(k))))


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for b in batches:
            a_out, b_out = [], []
            for hub, salt, role, node, text in zip(*(b.column(c).to_pylist() for c in ("hub", "salt", "role", "node", "text"))):
                if (hub, salt) != at:
                    at, hubs = (hub, salt), []
                mine = shingle_set(text, k)
                if role == 0:
                    hubs.append(mine)
                    continue
                for centre in hubs:
                    both = len(centre & mine)
                    if both and 100 * both >= percent * (len(centre) + len(mine) - both):
                        a_out.append(hub)
                        b_out.append(node)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def confirm_links(docs: DataFrame, pairs: DataFrame, k: int, percent: int, label: str) -> DataFrame:
    """Of distinct candidate pairs (a, b), those whose full shingle sets are alike enough."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    salts = sizes.withColumn("salts", F.ceil(F.col("c") / STAR_BLOCK).cast("int"))
    spokes = pairs.join(salts, "a").select(
        F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role")
    )
    centres = salts.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    n = partitions(docs.sparkSession)
    wanted = stash(spokes.select("node").unionByName(salts.select(F.col("a").alias("node"))).distinct(), "wanted")
    if wanted.limit(MAX_BROADCAST_NODES + 1).count() <= MAX_BROADCAST_NODES:
        docs = docs.join(F.broadcast(wanted), docs["doc_id"] == wanted["node"], "left_semi")
    placed = (
        spokes.unionByName(centres)
        .join(docs.select(F.col("doc_id").alias("node"), "text"), "node")
        .repartition(n, "hub", "salt")
        .sortWithinPartitions("hub", "salt", "role")
    )
    return stash(placed.select("hub", "salt", "role", "node", "text").mapInArrow(_confirm(k, percent), "a long, b long"), label)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents are linked if 100 * shared >= ``percent`` * all of their distinct
    k-word shingles (ASCII case folded; fewer than k words: the whole sequence
    as one shingle). component_id is the smallest doc_id that links reach; kept
    marks that document. Null or empty texts have no shingles and stay alone;
    equal texts are linked; rows of one doc_id count as one node whose texts
    all link it; a null doc_id is judged alone and kept; an empty table gives
    no rows; other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = stash(docs.mapInArrow(_sketch(k), "doc_id long, n long, h1 long, h2 long, sig binary, counts binary"), "sketches")
    sets = sketches.filter("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "sig", "counts")).alias("x"))
    nodes = stash(sets.select("h1", "h2", "n", F.col("x.doc_id").alias("node"), F.col("x.sig").alias("sig"), F.col("x.counts").alias("counts")), "nodes")
    signed = nodes.select("node", "sig")

    keys = signed.mapInArrow(_index_keys, "key long, hub long, node long")
    firsts = keys.filter("hub is null").select("key", "node").repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "node")
    grouped = firsts.mapInArrow(_group_keys, "key long, hub long, node long")
    members = stash(grouped.unionByName(keys.filter("hub is not null")), "members")
    stars = members.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    for s in ("a", "b"):
        stars = stars.join(nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("counts").alias(f"c{s}")), s)
    stars = stash(stars.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(_possible(percent), "a long, b long").distinct(), "stars")
    links = confirm_links(docs, stars, k, percent, "star-links")
    comps = stash(connected_components(links), "components")

    # Keys whose members are not yet joined: pairs across components.
    joined = comps.withColumnRenamed("component", "comp")
    placed = members.select("key", "node").unionByName(members.select("key", F.col("hub").alias("node"))).distinct()
    placed = stash(placed.join(joined, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "placed")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("c")).filter("x < y")
    open_keys = open_keys.select("key", F.ceil(F.col("c") / KEY_BLOCK).cast("int").alias("salts"))
    open_rows = placed.join(open_keys, "key").join(nodes.select("node", "n", "counts"), "node")
    # every member goes to every part of its key, and is the smaller of its pairs in one of them
    open_rows = open_rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("salts")) == F.col("salt"))
    open_rows = open_rows.select("key", "salt", "n", "node", "comp", "own", "counts").repartition(partitions(docs.sparkSession), "key", "salt").sortWithinPartitions("key", "salt", "n")
    across = open_rows.mapInArrow(_across(percent), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
    across = stash(across, "across")
    more = confirm_links(docs, across, k, percent, "more-links")
    many = sketches.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count_distinct("h1", "h2", "n").alias("c")).filter("c > 1")
    twice = sketches.filter("n > 0").join(many, "doc_id").join(nodes, ["h1", "h2", "n"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    comps = stash(connected_components(links.unionByName(more).unionByName(twice)), "components")

    by_set = nodes.join(comps, "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component"))
    found = sketches.join(by_set, ["h1", "h2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns.

    All rows of a kept doc_id stay, and so do rows without one.
    """
    gone = near_duplicates(docs, k, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""
