"""Operator 2: near-duplicate lines by a segment-partition edit join.

A line is cut into ``TAU + 1`` segments. Of two lines within ``TAU`` edits at
least one segment of the shorter (or of either, at equal lengths) occurs
unchanged in the other, near its own place. Each line is indexed by its
segments under (length, segment number), and probes the indexes of its own and
the next ``TAU`` smaller lengths with the few substrings whose place the
remaining edits allow. Pairs that meet are told apart by sketches, which go
with the keys: counts of 15 classes of bytes, of which an edit changes two by
one at most. Pairs that may be links are verified on their texts by a banded
bit-parallel edit distance. Lengths and edits count bytes of UTF-8; lines under
``MIN_BYTES`` are only equal to themselves.

Equal lines are one node from the start. A key that more than ``HOT`` lines
share is not expanded, unless ``HOT * BLOCKS`` lines at most share it and their
sketches leave few pairs: its lines are keyed again by the segments of what is
left of them without the shared segment and without the start and end that the
whole group shares (these rests must also agree within ``TAU`` edits), and so
on until no key is hot. A segment without bytes, which only rests of up to
``2 * TAU`` bytes have, is the end of it: nearly all its pairs are links.

Scale: lines are cut and hashed once, into a table of (hash, place); one
shuffle of it and one of 12 keys a line. Texts move only for lines that have a
candidate, and only the documents in which such lines occur first are read
again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .textwords import mix64, split_words, text_column
from .workspace import bounded_batches, partitions, stash

TAU = 2
MIN_BYTES = 24
HOT = 256
#: Keys of up to so many times HOT lines are expanded if their sketches leave at most LEFT pairs a line.
BLOCKS, LEFT = 16, 8
#: Candidate lines whose hashes may be broadcast (8 bytes each); beyond it they are joined.
MAX_BROADCAST_LINES = 200_000
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_MASK = (1 << 64) - 1
PROBE, INDEX, LAST = 1, 2, 4
#: A mark has a key's roles in its lowest bits and the line's sketch above them.
_ROLES = 3
_SKETCH = np.uint64((1 << 60) - 1)


def _weights() -> np.ndarray:
    """What each byte adds to a sketch: one in a counter of 4 bits, which may run over into the next."""
    at = np.arange(256) % 15
    for rank, letter in enumerate(" etaoinsrhdlucmfpgwybvkjxqz"):
        for c in (letter, letter.upper()):
            at[ord(c)] = rank if rank < 15 else 29 - rank
    return np.uint64(1) << (at.astype(np.uint64) * np.uint64(4))


_WEIGHT = _weights()
#: Of each four counters, that hold 8 if two lines agree, by how much they differ.
_DIFFER = sum(abs((np.arange(1 << 16) >> 4 * i & 15) - 8) for i in range(4)).astype(np.uint8)
_EVEN = np.uint64(0x0888888888888888)


def may_be_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether lines of these sketches can be within TAU edits, each of which changes counts by two at most."""
    d = np.ascontiguousarray((a - b + _EVEN) & _SKETCH | np.uint64(8 << 60))
    far = _DIFFER[d.view(np.uint16).reshape(*d.shape, 4)]
    return far[..., 0] + far[..., 1] + far[..., 2] + far[..., 3] <= 2 * TAU


def sketches(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sketch of each span of bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_WEIGHT[data], out=sums[1:])
    return (sums[end] - sums[start]) & _SKETCH


def edits_within(a: bytes, b: bytes, limit: int = TAU) -> int | None:
    """Edit distance if it is at most ``limit`` (under 31), else None."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return None
    lo, most = 0, len(b)
    while lo < most and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not b:
        return len(a)
    # For each byte the rows of the band in which it occurs: bit 63 is row (seen - 1), whatever is older has moved out.
    places: dict[int, tuple[int, int]] = {}
    seen = 0
    # Bit 63 lies on the band's lower diagonal; the window moves down one row a column.
    below = max(0, limit - len(a))  # rows of the band under a short text
    up, down, dist, at = (_MASK << (63 - limit)) & _MASK, 0, limit - below, limit - 63
    edge, give_up = 1 << (62 - below), limit + len(b) - max(0, len(a) - limit)
    for j, c in enumerate(b):
        while seen < min(len(a), at + 64):
            bits, top = places.get(a[seen], (0, seen))
            places[a[seen]] = (bits >> (seen - top) | 1 << 63 if seen - top < 64 else 1 << 63), seen
            seen += 1
        bits, top = places.get(c, (0, at))
        move = at + 63 - top  # bit 63 is to be row (at + 63)
        x = bits >> move if move < 64 else 0
        diag = ((((x & up) + up) & _MASK) ^ up) | x | down
        right, left = down | (~(diag | up) & _MASK), diag & up
        if j < len(a) - limit:
            dist += not diag >> 63
        else:
            dist += (right & edge > 0) - (left & edge > 0)
            edge >>= 1
        if dist > give_up:
            return None
        half = diag >> 1
        up, down = left | (~(half | right) & _MASK), half & right
        at += 1
    return dist if dist <= limit else None


def _spans(length: np.ndarray, least: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(segment, length difference, start, end, which lines, roles) of every key of lines; indexed ones have ``least`` bytes."""
    for gap in range(TAU + 1):  # the indexed line is this much shorter
        short = length - gap
        for i in range(TAU + 1):
            first, last = short * i // (TAU + 1), short * (i + 1) // (TAU + 1)
            for move in range(-TAU, TAU + 1):
                if abs(move) > i or abs(move - gap) > TAU - i:
                    continue
                ok = (first + move >= 0) & (last + move <= length) & (short >= least)
                yield i, gap, first + move, last + move, ok, PROBE | (INDEX if gap == 0 and move == 0 else 0)


def _hash64(lines: list[bytes]) -> np.ndarray:
    """The engine's ``xxhash64`` of each line."""
    return np.array([xxhash.xxh64_intdigest(x, 42) for x in lines], np.uint64)


def _salt(i: int, short: np.ndarray) -> np.ndarray:
    return mix64(short.astype(np.uint64) * np.uint64(8) + np.uint64(i + 1))


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for words in split_words(text_column(b), False, _NEWLINE):
            length = words.end - words.start
            use = np.flatnonzero(length >= MIN_BYTES)
            raw = words.data.tobytes()
            h = _hash64([raw[s:e] for s, e in zip(words.start[use].tolist(), words.end[use].tolist())])
            h, one = np.unique(h, return_index=True)
            start, length = words.start[use][one], length[use][one]
            sketch = sketches(words.data, start, start + length).view(np.int64) << _ROLES
            keys, lines, marks = [], [], []
            for i, gap, s, e, ok, role in _spans(length):
                k = mix64(words.hashes((start + s)[ok], (start + e)[ok]) ^ _salt(i, (length - gap)[ok]))
                keys.append(k)
                lines.append(h[ok])
                marks.append(sketch[ok] | role)
            if len(h):
                yield _keyed(np.concatenate(keys), np.concatenate(lines), np.concatenate(marks))


_ROWS = pa.schema([("key", pa.int64()), ("line", pa.int64()), ("mark", pa.int64())])
_REST_ROWS = pa.schema([*_ROWS, ("spot", pa.int64()), ("path", pa.binary())])


def _keyed(key: np.ndarray, line: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(line.view(np.int64)), pa.array(mark)], schema=_ROWS)


def _without(raw: bytes, path: bytes) -> bytes:
    """What is left of a line after its spans in ``path`` are cut out one by one."""
    for s, e in np.frombuffer(path, "<i4").reshape(-1, 2).tolist():
        raw = raw[:s] + raw[e:]
    return raw


def _step_out(*spans: tuple[int, int]) -> bytes:
    return np.array([x for span in spans if span[0] < span[1] for x in span], "<i4").tobytes()


def _matching(raw: bytes, key: int) -> Iterator[bytes]:
    """Paths of one step: every span of a line that gives this key of the first level."""
    words = next(split_words(pa.array([raw.decode()], pa.large_string()), False, _NEWLINE), None)
    if words is not None:
        n = np.array([len(raw)])
        for i, gap, s, e, ok, _ in _spans(n):
            if ok[0] and int(mix64(words.hashes(s, e) ^ _salt(i, n - gap)).view(np.int64)[0]) == key:
                yield _step_out((int(s[0]), int(e[0])))


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What remains of each line without the segment that made its key hot, forwards and backwards."""
    schema = pa.schema([*_ROWS, ("path", pa.binary()), ("rest", pa.binary()), ("back", pa.binary())])
    for b in batches:
        out = []
        for key, line, mark, path, text in zip(*(b.column(c).to_pylist() for c in ("key", "line", "mark", "path", "line_text"))):
            raw = (text or "").encode()
            for p in set(_matching(raw, key)) if path is None else (path,):
                rest = _without(raw, p)
                out.append((key, line, mark, p, rest, rest[::-1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(t, np.uint8, n) for t in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def _rest_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the rests of a group, without the start and the end that all of them share."""
    for b in batches:
        out: list[tuple] = []
        for key, line, mark, path, rest, lo, hi, back_lo, back_hi, least in zip(
            *(b.column(c).to_pylist() for c in ("key", "line", "mark", "path", "rest", "lo", "hi", "back_lo", "back_hi", "least"))
        ):
            start = _common(lo, hi)
            end = min(_common(back_lo, back_hi), least - start)
            mid = rest[start : len(rest) - end]
            under = mix64(np.array([key], np.int64).view(np.uint64))
            trim = _step_out((len(rest) - end, len(rest)), (0, start))
            n = np.array([len(mid)])
            for i, gap, s, e, ok, own in _spans(n, 0):
                if not ok[0]:
                    continue
                s, e = int(s[0]), int(e[0])
                k = mix64(_hash64([mid[s:e]]) ^ _salt(i, n - gap) ^ under).view(np.int64)[0]
                cut = path + trim + _step_out((s, e))
                # the first level's role limits the next one's
                roles = (own if mark & INDEX else own & PROBE) | (0 if s < e else LAST)
                out.append((k, line, mark >> _ROLES << _ROLES | roles, int(_hash64([cut]).view(np.int64)[0]), cut))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _REST_ROWS.types)], schema=_REST_ROWS)


def _meet(most: int):
    """Pairs of lines under equal keys that may be links by their sketches; of hot keys, their rows.

    Rows come sorted by (key, line). A key of up to ``most`` lines gives its
    pairs; one of up to BLOCKS times as many does if they are few, and else is
    hot, as any of more lines. A group is held until its end, and given on as
    it is as soon as it is hot, unless its keys are of empty segments.
    """
    schema = pa.schema([("hot", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("mark", pa.int64()), ("path", pa.binary())])
    many = most * BLOCKS

    def paired(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), pa.array(a), pa.array(b), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary())], schema=schema)

    def pairs(line: np.ndarray, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
        line, one, which = np.unique(line, return_index=True, return_inverse=True)
        sketch = (mark[one] >> _ROLES).view(np.uint64)
        index = np.unique(which[mark & INDEX > 0])
        for lo in range(0, len(index), 256):
            x, y = np.nonzero(may_be_near(sketch[index[lo : lo + 256], None], sketch))
            x = index[lo : lo + 256][x]
            new = x != y
            a, b = np.minimum(x, y)[new], np.maximum(x, y)[new]
            if len(a):
                a, b = np.divmod(np.unique(a * len(line) + b), len(line))
                yield paired(line[a], line[b])

    def rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
        path = t.column("path") if "path" in t.column_names else pa.chunked_array([pa.nulls(t.num_rows, pa.binary())])
        out = pa.table([pa.array(np.ones(t.num_rows, bool)), t.column("key"), t.column("line"), t.column("mark"), path], schema=schema)
        yield from out.to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        hot_key = None

        def groups(t: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
            """All groups of ``t``; its last one too only if it is ``whole``, else it is held."""
            nonlocal held, hot_key
            held = None
            key, line, mark = (t.column(c).to_numpy() for c in ("key", "line", "mark"))
            if hot_key is not None:
                n = int(np.searchsorted(key != hot_key, True))
                if n:
                    yield from rows(t.slice(0, n))
                    t, key, line, mark = t.slice(n), key[n:], line[n:], mark[n:]
                if len(key):
                    hot_key = None
            if not len(key):
                return
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(cut[1:], len(key))
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])])
            lines = np.add.reduceat(fresh.astype(np.int64), cut)
            last = np.bitwise_or.reduceat(mark, cut) & LAST > 0
            if not whole:
                x = int(cut[-1])
                if lines[-1] > many and not last[-1]:
                    yield from rows(t.slice(x))
                    hot_key = int(key[-1])
                else:
                    held = t.slice(x)
                cut, ends, lines, last = cut[:-1], ends[:-1], lines[:-1], last[:-1]
            two = np.flatnonzero((lines == 2) & (ends - cut == 2))
            x, y = cut[two], cut[two] + 1
            meet = (mark[x] | mark[y]) & INDEX > 0
            meet &= may_be_near(*((mark[z] >> _ROLES).view(np.uint64) for z in (x, y)))
            if meet.any():
                x, y = line[x][meet], line[y][meet]
                yield paired(np.minimum(x, y), np.maximum(x, y))
            for g in np.flatnonzero((lines > 1) & ~((lines == 2) & (ends - cut == 2))).tolist():
                x, y = int(cut[g]), int(ends[g])
                if lines[g] <= most or last[g]:
                    yield from pairs(line[x:y], mark[x:y])
                    continue
                found, left = [], LEFT * int(lines[g]) if lines[g] <= many else -1
                for batch in pairs(line[x:y], mark[x:y]) if left >= 0 else ():
                    found.append(batch)
                    left -= batch.num_rows
                    if left < 0:
                        break
                yield from found if left >= 0 else rows(t.slice(x, y - x))

        for b in batches:
            if b.num_rows:
                now = pa.Table.from_batches([b])
                yield from groups(pa.concat_tables([held, now]).combine_chunks() if held is not None else now, False)
        if held is not None:
            yield from groups(held, True)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = [], []
        for x, y, s, t in zip(*(b.column(n).to_pylist() for n in ("a", "b", "ta", "tb"))):
            if edits_within(s.encode(), t.encode()) is not None:
                a.append(x)
                c.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])


def _lines_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.ltrim("line_text", F.lit(" \t\r\x0b\x0c")) == ""
    return docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line_text")).select(
        "doc_id", "version", "line_no", F.xxhash64("line_text").alias("h1"), F.xxhash64("line_text", F.lit(1)).alias("h2"), blank.alias("blank")
    )


def _small(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` in a table of their own, to be broadcast if they are at most MAX_BROADCAST_LINES."""
    rows = stash(rows, label)
    return F.broadcast(rows) if rows.limit(MAX_BROADCAST_LINES + 1).count() <= MAX_BROADCAST_LINES else rows


def _texts(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct (h1, h2, line_text) of the lines whose h1 is in ``wanted`` (h1), read where they occur first."""
    wanted = _small(wanted.distinct(), "wanted")
    where = lines.join(wanted, "h1", "left_semi").groupBy(F.col("first.doc_id").alias("_at")).agg(F.collect_set("first.line_no").alias("_nos"))
    where = _small(where, "places")
    found = docs.join(where, docs["doc_id"].eqNullSafe(where["_at"])).select(F.explode("_nos").alias("_no"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_lines"))
    found = found.select(F.get("_lines", "_no").alias("line_text")).filter("line_text is not null")
    found = found.select(F.xxhash64("line_text").alias("h1"), F.xxhash64("line_text", F.lit(1)).alias("h2"), "line_text")
    return found.join(wanted, "h1", "left_semi").groupBy("h1", "h2").agg(F.min("line_text").alias("line_text"))


def line_links(docs: DataFrame, occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, links) of texts and their ``_lines_of``: distinct lines (line, h1, h2, first, n) and pairs (a, b) of line ids within TAU edits."""
    bounded_batches(docs.sparkSession)
    n = partitions(docs.sparkSession)
    lines = occurrences.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    lines = stash(lines.withColumn("line", F.monotonically_increasing_id()), "lines")

    def met(keys: DataFrame) -> DataFrame:
        placed = keys.repartition(n, "key").sortWithinPartitions("key", "line")
        return stash(placed.mapInArrow(_meet(HOT), "hot boolean, a long, b long, mark long, path binary"), "met")

    found = met(docs.select("text").mapInArrow(_line_keys, "key long, line long, mark long"))
    pairs = found.filter("not hot").select("a", "b")
    while True:
        hot = found.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("line"), "mark", "path")
        if hot.isEmpty():
            break
        texts = _texts(docs, lines, hot.select(F.col("line").alias("h1"))).select("h1", "line_text")
        rests = hot.join(texts, hot["line"] == texts["h1"]).select("key", "line", "mark", "path", "line_text")
        rests = stash(rests.mapInArrow(_rests, "key long, line long, mark long, path binary, rest binary, back binary"), "rests")
        ends = [f("rest").alias(a) for a, f in (("lo", F.min), ("hi", F.max))] + [f("back").alias(f"back_{a}") for a, f in (("lo", F.min), ("hi", F.max))]
        groups = rests.groupBy("key").agg(*ends, F.min(F.length("rest")).alias("least"), F.max(F.col("mark").bitwiseAND(INDEX)).alias("_any"))
        keyed = rests.drop("back").join(_small(groups.filter("_any > 0").drop("_any"), "groups"), "key")  # probes alone meet nobody
        found = met(keyed.mapInArrow(_rest_keys, "key long, line long, mark long, spot long, path binary").dropDuplicates(["key", "line", "spot"]))
        pairs = pairs.unionByName(found.filter("not hot").select("a", "b"))
    pairs = stash(pairs.distinct(), "line-pairs")
    texts = _texts(docs, lines, pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))))
    texts = stash(texts.join(lines.select("h1", "h2", "line"), ["h1", "h2"]), "line-texts")
    ta, tb = (texts.select(F.col("h1").alias(f"h{s}"), F.col("line").alias(f"l{s}"), F.col("line_text").alias(f"t{s}")) for s in ("a", "b"))
    candidates = pairs.join(ta, F.col("a") == F.col("ha")).join(tb, F.col("b") == F.col("hb")).select(F.col("la").alias("a"), F.col("lb").alias("b"), "ta", "tb")
    return lines, stash(candidates.mapInArrow(_verify, "a long, b long").distinct(), "line-links")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, n_links, removed_lines, first_docs.

    Lines are what newlines separate. Lines within TAU edits (of at least
    MIN_BYTES bytes), and equal lines of any length that hold more than white
    space, form classes by chains of links; of each class the first occurrence
    (by doc_id, then line number) stays and all others are removed. n_links
    sums, over the document's lines, the different lines that each is linked
    with; removed_lines are line numbers from 0; first_docs has for each line
    the doc_id of its class's first occurrence. A null or empty text is one
    empty line; blank lines are never removed; repeated rows of one doc_id and
    text count once, rows of one doc_id and other texts are rows of their own;
    a null doc_id sorts first; an empty table gives no rows; other columns are
    not looked at.
    """
    return _judged(docs).drop("version")


def _judged(docs: DataFrame) -> DataFrame:
    """The rows of ``dedup_lines`` with the ``version`` (hash of the text) that they belong to."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    occurrences = stash(_lines_of(docs), "occurrences")
    lines, links = line_links(docs, occurrences)
    comps = connected_components(links)
    degree = links.select(F.col("a").alias("line")).unionByName(links.select(F.col("b").alias("line"))).groupBy("line").agg(F.count(F.lit(1)).alias("links"))
    classes = comps.join(lines.select(F.col("line").alias("node"), "first"), "node")
    firsts = classes.groupBy("component").agg(F.min("first").alias("class_first"))
    linked = comps.join(firsts, "component").join(degree, comps["node"] == degree["line"]).select("line", "class_first", "links")
    judged = lines.join(linked, "line", "left").select("h1", "h2", F.coalesce("class_first", "first").alias("first"), F.coalesce("links", F.lit(0)).alias("links"))
    at = F.struct("doc_id", "line_no")
    each = F.sort_array(F.collect_set(F.struct("line_no", "gone", "links", "first_doc")))
    return (
        occurrences.join(judged, ["h1", "h2"])
        .withColumn("gone", ~F.col("blank") & ~at.eqNullSafe(F.col("first")))
        .withColumn("first_doc", F.col("first.doc_id"))
        .groupBy("doc_id", "version")
        .agg(each.alias("x"))
        .select(
            "doc_id",
            "version",
            F.size("x").cast("long").alias("n_lines"),
            F.size(F.filter("x", lambda r: r["gone"])).cast("long").alias("n_removed"),
            F.aggregate("x", F.lit(0).cast("long"), lambda s, r: s + r["links"]).alias("n_links"),
            F.transform(F.filter("x", lambda r: r["gone"]), lambda r: r["line_no"]).alias("removed_lines"),
            F.transform("x", lambda r: r["first_doc"]).alias("first_docs"),
        )
    )


def drop_duplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that ``dedup_lines`` removes cut out of ``text``.

    Rows and columns stay, also those named like this operator's own; a row
    from which nothing is removed (a null or empty text, for one) keeps its
    text as it is; a text of which nothing stays becomes empty.
    """
    found = _judged(docs).filter("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("removed_lines").alias("_gone"))
    # the caller's columns travel as one, so no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("_row.text").cast("string")) == F.col("_version"))
    joined = rows.join(found, same, "left")
    kept = F.filter(F.split(F.col("_row.text"), "\n", -1), lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE o AS (
  SELECT doc_id, md5(text) AS version, generate_subscripts(ls, 1)::INTEGER - 1 AS line_no, unnest(ls) AS line
  FROM (SELECT DISTINCT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
l AS (SELECT line, strlen(line) AS n, min({'d': doc_id, 'l': line_no}) AS first FROM o GROUP BY line),
p AS (SELECT a.line AS a, b.line AS b FROM l a JOIN l b ON a.n >= 24 AND b.n BETWEEN greatest(24, a.n - 2) AND a.n + 2 AND a.line <> b.line
  WHERE levenshtein(a.line, b.line) <= 2),
r(node, first) AS (SELECT line, first FROM l UNION SELECT p.b, r.first FROM r JOIN p ON p.a = r.node JOIN l ON l.line = p.b WHERE r.first < l.first),
c AS (SELECT node, min(first) AS first FROM r GROUP BY node),
g AS (SELECT a, count(*) AS links FROM p GROUP BY a),
j AS (SELECT o.*, c.first AS cf, coalesce(g.links, 0) AS links,
    regexp_matches(o.line, '[^\x20\x09\x0B-\x0D]') AND {'d': o.doc_id, 'l': o.line_no} <> c.first AS gone
  FROM o JOIN c ON c.node = o.line LEFT JOIN g ON g.a = o.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sum(links)::BIGINT AS n_links,
  coalesce(list(line_no ORDER BY line_no) FILTER (gone), []) AS removed_lines, list(cf.d ORDER BY line_no) AS first_docs
FROM j GROUP BY doc_id, version
"""
