"""Operator 7: repeated passages by suffix automata of reference shards.

A window of ``WINDOW`` words has an anchor: the smallest hash among its runs of
``GRAM`` words. Equal windows have equal anchors, so windows are compared
within shards made by anchor. A shard holds, of the passages around an anchor
that more than one document has, each different one once with its smallest
doc_id. Going through a shard by ascending doc_id, each passage is streamed
through the suffix automaton of the passages of smaller ids; wherever the
matching statistic reaches the window's length a window is repeated. Repeated
windows go back to the documents, and the words they cover are removed.

The automata of the whole corpus grow with it and cannot be broadcast; routing
by anchor brings to each automaton just the documents that could match it.

Scale: texts are written once in blocks and scanned, never shuffled. Groups of
blocks send each anchor once (combined over their documents) and get back those
that are shared; blocks send each different passage once. An anchor in more than
``HOT_ROWS`` documents is split: its windows are sent one by one, each to the
shard of its own hash, so no shard holds all that a common anchor meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import SideReader, by_bucket, each_group, make_blocks, place_in_file, write_side
from .textwords import Words, mix64, shingle_hashes, split_words
from .workspace import partitions

WINDOW = 13
GRAM = 5
HOT_ROWS = 20_000
#: Bytes of passages that a task holds before it sends them.
SEND_BYTES = 16 << 20
#: Bits of a piece's index in its block.
_PIECE = 32
_LAST = (1 << 63) - 1
_WHOLE = np.uint32(0xFFFFFFFF)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _blocks_words(ids: list[int | None], texts: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    """Words of a block as one piece, and its ids (null: the largest)."""
    for words in split_words(texts, False, max_bytes=1 << 62):
        yield words, np.array([_LAST if i is None else i for i in ids], np.int64)


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, row, anchor) of every window that lies within a document."""
    h = words.hashes()
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    m, span, need = shingle_hashes(h, min(GRAM, window)), 1, window - min(GRAM, window) + 1
    low = m
    while span * 2 <= need:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < need:
        low = np.minimum(low[: len(h) - window + 1], low[need - span :][: len(h) - window + 1])
    row = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    first = np.arange(len(low))
    inside = first + window <= words.bounds[1:][row[: len(low)]]
    return first[inside], row[: len(low)][inside], low[inside]


def _send_anchors(buckets: int, window: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("anchors", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, blocks in each_group(batches):
            each = []
            for _, ids, texts in blocks:
                for words, _ in _blocks_words(ids, texts):
                    _, row, a = _anchors(words, window)
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
                    row, a = row[new], a[new]
                    order = np.lexsort((row, a))
                    row, a = row[order], a[order]
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
                    each.append(a[new])
            a, count = np.unique(np.concatenate(each), return_counts=True)
            if len(a):
                yield from _bucketed(schema, group, (a % np.uint64(buckets)).astype(np.int64), a, count.astype(np.uint32))

    return run


def _bucketed(schema: pa.Schema, block: int, bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(cut[1:], len(bucket))
    packed = [[x[lo:hi].tobytes() for lo, hi in zip(cut, ends)] for x in (a[order] for a in arrays)]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array(np.full(len(cut), block)), *(pa.array(p, pa.binary()) for p in packed)], schema=schema)


def _column(table: pa.Table, name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """A packed column's values and the row that each is of."""
    parts = table.column(name).to_pylist()
    size = np.array([len(p) for p in parts]) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(parts), dtype), np.repeat(np.arange(len(parts)), size)


def _shared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Per group of blocks, its anchors that several documents have, and which of them are hot."""
    a, row = _column(table, "anchors", np.uint64)
    count, _ = _column(table, "counts", np.uint32)
    blocks = table.column("block").to_numpy()
    each, inverse = np.unique(a, return_inverse=True)
    total = np.bincount(inverse, count, len(each))[inverse]
    keep = total > 1
    a, row, hot = a[keep], row[keep], (total > HOT_ROWS)[keep]
    cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(row))
    if len(cut):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blocks[row[cut]]),
                pa.array([a[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary()),
                pa.array([hot[x:y].astype(np.uint8).tobytes() for x, y in zip(cut, ends)], pa.binary()),
            ],
            ["block", "anchors", "hot"],
        )


class Passages:
    """Passages of a block: runs of windows with one shared anchor.

    key: the anchor (a window's own hash if hot); piece: index of the different
    passages; first, n, row: first word, windows and row of each occurrence;
    one: an occurrence of each piece in the smallest id that has it.
    """

    def __init__(self, words: Words, ids: np.ndarray, shared: list[dict], window: int):
        self.words = words
        first, row, a = _anchors(words, window)
        known = np.frombuffer(b"".join(r["anchors"] for r in shared), np.uint64)
        hot = np.frombuffer(b"".join(r["hot"] for r in shared), np.uint8) > 0
        order = np.argsort(known, kind="stable")
        known, hot = known[order], hot[order]
        if not len(known) or not len(a):
            self.n = np.zeros(0, np.int64)
            return
        at = np.minimum(np.searchsorted(known, a), len(known) - 1)
        use = known[at] == a
        first, row, a, hot = first[use], row[use], a[use], hot[at[use]]
        start = np.ones(len(a), bool)
        start[1:] = hot[1:] | (a[1:] != a[:-1]) | (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)
        cut = np.flatnonzero(start)
        self.first, self.row, self.n = first[cut], row[cut], np.diff(np.append(cut, len(a)))
        if not len(cut):
            return
        h = words.hashes()
        step = np.full(len(h) + 1, _STEP, np.uint64)
        back = np.full(len(h) + 1, _BACK, np.uint64)
        step[0] = back[0] = 1
        step, back = np.multiply.accumulate(step), np.multiply.accumulate(back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * step[:-1])])
        end = self.first + self.n + window - 1
        content = mix64((sums[end] - sums[self.first]) * back[self.first] + (end - self.first).astype(np.uint64))
        key = np.where(hot[cut], content, a[cut])
        self.id = ids[self.row]
        order = np.lexsort((self.id, content, key))
        k, c = key[order], content[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        self.piece = np.empty(len(k), np.int64)
        self.piece[order] = np.cumsum(new) - 1
        self.one = order[new]
        self.key, self.end = k[new], end


def _plain(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The block's words with one space between them, and each word's start and end there."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    at = np.arange(len(out)) - np.repeat(start, size + 1)
    inside = at < np.repeat(size, size + 1)
    out[inside] = words.data[(np.repeat(words.start, size + 1) + at)[inside]]
    return out.tobytes(), start, end


def _in_order(rows: list[dict]) -> list[dict]:
    """A group's shared anchors in one row, sorted once for all of its blocks."""
    if not rows:
        return []
    known, hot = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("anchors", np.uint64), ("hot", np.uint8)))
    order = np.argsort(known)
    return [{"anchors": known[order].tobytes(), "hot": hot[order].tobytes()}]


def _send_passages(uri: str, buckets: int, window: int):
    """Passages of a group of blocks by bucket; a piece's place in its file and its index in the block are one number."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in ("key", "piece", "id", "size", "text"))])

    def send(group: int, held: list[tuple]) -> pa.RecordBatch:
        key, piece, id_one, size = (np.concatenate([x[c] for x in held]) for c in range(4))
        bucket = (mix64(key) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        b, texts = bucket[order], [t for x in held for t in x[4]]
        cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        ends, text = np.append(cut[1:], len(b)), [texts[i] for i in order.tolist()]
        cols = [[x[s:e].tobytes() for s, e in zip(cut, ends)] for x in (key[order], piece[order], id_one[order], size[order])]
        blobs = [b"".join(text[s:e]) for s, e in zip(cut, ends)]
        return pa.RecordBatch.from_arrays([pa.array(b[cut], pa.int32()), pa.array(np.full(len(cut), group)), *(pa.array(c, pa.binary()) for c in (*cols, blobs))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = SideReader(uri)
        for group, blocks in each_group(batches):
            shared, held, n = _in_order(side.get(group)), [], 0
            for block, ids, texts in blocks:
                for words, id_of in _blocks_words(ids, texts):
                    p = Passages(words, id_of, shared, window)
                    if not len(p.n):
                        continue
                    raw, start, end = _plain(words)
                    lo, hi = start[p.first[p.one]], end[p.end[p.one] - 1]
                    piece = np.arange(len(p.one)) + (place_in_file(block) << _PIECE)
                    held.append((p.key, piece, p.id[p.one], (hi - lo).astype(np.uint32), [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())]))
                    n += int((hi - lo).sum())
                    if n >= SEND_BYTES:
                        yield send(group, held)
                        held, n = [], 0
            if held:
                yield send(group, held)

    return run


class SuffixAutomaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def add(self, words: list) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None and size[q] == size[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(size)
                nxt.append({})
                link.append(0)
                size.append(size[last] + 1)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][c]
                if size[q] == size[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
                link[cur] = clone = len(size)
                then = cur
            else:
                p, clone = last, len(size)
                then = clone
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            link[q] = clone
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            last = then

    def matching(self, words: list) -> list[int]:
        """For each word, the longest run ending there that is in a sequence."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        out = []
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
            out.append(length)
        return out


def repeated_windows(passages: list[tuple[int, bytes]], window: int) -> list[list[int] | None]:
    """For each (id, passage) of a shard, in ascending id order: the windows that
    smaller ids have; None: all of them."""
    out: list[list[int] | None] = []
    first: dict[bytes, int] = {}
    auto, waiting, at = SuffixAutomaton(), [], None
    for i, text in passages:
        if i != at:
            for w in waiting:
                auto.add(w)
            waiting, at = [], i
        if first.setdefault(text, i) < i:
            out.append(None)
            continue
        words = text.split(b" ")
        if len(auto.size) == 1:
            out.append([])
        else:
            out.append([j - window + 1 for j, n in enumerate(auto.matching(words)) if n >= window])
        waiting.append(words)
    return out


def _judge(window: int):
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, row = _column(table, "key", np.uint64)
        piece, _ = _column(table, "piece", np.int64)
        ids, _ = _column(table, "id", np.int64)
        size, _ = _column(table, "size", np.uint32)
        blob = b"".join(table.column("text").to_pylist())
        stop = np.cumsum(size.astype(np.int64))
        start = stop - size
        blocks = table.column("block").to_numpy()
        order = np.lexsort((ids, key))
        k = key[order]
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        ends = np.append(cut[1:], len(k))
        several = ends - cut > 1
        o_row: list[int] = []
        o_piece: list[int] = []
        o_window: list[int] = []
        for lo, hi in zip(cut[several].tolist(), ends[several].tolist()):
            mine = order[lo:hi].tolist()
            if ids[mine[0]] == ids[mine[-1]]:
                continue
            found = repeated_windows([(int(ids[i]), blob[start[i] : stop[i]]) for i in mine], window)
            for i, w in zip(mine, found):
                for x in [int(_WHOLE)] if w is None else w:
                    o_row.append(row[i])
                    o_piece.append(piece[i])
                    o_window.append(x)
        if not o_row:
            return
        r = np.array(o_row)
        order = np.argsort(r, kind="stable")
        r, p, w = r[order], np.array(o_piece, np.int64)[order], np.array(o_window, np.uint32)[order]
        cut = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        ends = np.append(cut[1:], len(r))
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks[r[cut]]), *(pa.array([x[s:e].tobytes() for s, e in zip(cut, ends)], pa.binary()) for x in (p, w))], ["block", "piece", "window"]
        )

    return run


def _remove(shared_uri: str, answer_uri: str, window: int, with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, ("text", pa.string())] if with_text else fields)

    def blocks(batches: Iterator[pa.RecordBatch], shared: SideReader, answers: SideReader) -> Iterator[tuple]:
        """Each block with its group's shared anchors, and its own repeated pieces and their windows."""
        for group, own in each_group(batches):
            anchors, rows = _in_order(shared.get(group)), answers.get(group)
            piece, at = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("piece", np.int64), ("window", np.uint32)))
            order = np.argsort(piece, kind="stable")
            piece, at = piece[order], at[order]
            for block, ids, texts in own:
                lo, hi = np.searchsorted(piece, [place_in_file(block) << _PIECE, place_in_file(block) + 1 << _PIECE])
                yield block, ids, texts, anchors, (piece[lo:hi] & (1 << _PIECE) - 1, at[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, answers = SideReader(shared_uri), SideReader(answer_uri)
        for block, ids, texts, anchors, found in blocks(batches, shared, answers):
            for words, id_of in _blocks_words(ids, texts):
                p = Passages(words, id_of, anchors, window)
                gone = np.zeros(len(words.start) + 1, np.int64)
                if len(p.n):
                    least = p.id[p.one][p.piece]
                    whole = p.id > least  # the block itself has it in a smaller id
                    piece, at = found
                    every = np.zeros(len(p.one), bool)
                    every[piece[at == _WHOLE]] = True
                    whole |= every[p.piece]
                    np.add.at(gone, p.first[whole], 1)
                    np.add.at(gone, (p.first + p.n + window - 1)[whole], -1)
                    some = at != _WHOLE
                    if some.any():
                        piece, at = piece[some], at[some].astype(np.int64)
                        order = np.argsort(piece, kind="stable")
                        piece, at = piece[order], at[order]
                        todo = np.flatnonzero(~whole)
                        lo, hi = np.searchsorted(piece, p.piece[todo], "left"), np.searchsorted(piece, p.piece[todo], "right")
                        n = hi - lo
                        if n.sum():
                            which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                            s = np.repeat(p.first[todo], n) + at[which]
                            np.add.at(gone, s, 1)
                            np.add.at(gone, s + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                raw, start, end = _plain(words)
                out = []
                for d, lo, hi in zip(ids, words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                    cut = int(gone[lo:hi].sum())
                    if not cut:
                        kept = raw[start[lo] : end[hi - 1]] if hi > lo else b""
                    else:
                        stay = lo + np.flatnonzero(~gone[lo:hi])
                        kept = b" ".join([raw[a:b] for a, b in zip(start[stay].tolist(), end[stay].tolist())])
                    out.append((d, hi - lo, cut, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document, with the kept ``text`` if asked.

    Words are runs of characters other than the space and the controls 9 to 13.
    Each word is removed that lies in a window of ``window`` words which also
    starts in a document with a smaller doc_id, in the input as it is. Null or
    empty texts have no words; a null doc_id is larger than any other; repeats
    within a doc_id, or between repeated rows of one, remove nothing; an empty
    table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    blocks = make_blocks(docs)
    sent = blocks.mapInArrow(_send_anchors(buckets, window), "bucket int, block long, anchors binary, counts binary")
    shared = write_side(by_bucket(sent, _shared, "block long, anchors binary, hot binary"), "anchors")
    sent = blocks.mapInArrow(_send_passages(shared, buckets, window), "bucket int, block long, key binary, piece binary, id binary, size binary, text binary")
    answers = write_side(by_bucket(sent, _judge(window), "block long, piece binary, window binary"), "repeats")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")
    return blocks.mapInArrow(_remove(shared, answers, window, with_text), schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d)),
m AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win),
g AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS p FROM w JOIN m USING (win) WHERE low < doc_id),
s AS (SELECT r, list(p) AS gone FROM g GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [x for x, i in ws if NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN s USING (r)
"""
