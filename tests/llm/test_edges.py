"""Every operator over nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cidrloom.llm import components, decontam, linededup, lm, mixing, neardup, planes, substrings, topk, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key int, bucket string, block double, component string"
COMMON = "the same long passage of words that many documents share with each other in this table of tests and it goes on"


def words(n, salt):
    return " ".join(f"w{salt}x{i * 7 % 1000}" for i in range(n))


ROWS = [
    (1, COMMON + " first"), (2, COMMON + " second"), (3, COMMON + " first"), (4, None), (5, ""), (6, " \t\n"), (7, "a b"), (8, "A B"),
    (9, words(30000, 1)), (10, words(60, 2)), (11, words(60, 2) + " tail"), (12, "line one of the text is here\nshort\nline one of the text is hers\nshort"),
    (13, "é ü 漢字 a\u00a0b \x1c"), (None, words(40, 3)), (14, "x" * 50000), (15, COMMON + " first"), (15, COMMON + " first"), (16, "one"), (16, words(25, 5)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s0" if (i or 0) % 2 else None, None, "n", 1, "b", 0.5, "c") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def split(text, lower=True):
    raw = (text or "").encode()
    return (raw.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) if lower else raw).split()


def sets(text, k):
    w = split(text)
    return ({tuple(w)} if w else set()) if len(w) < k else set(zip(*(w[i:] for i in range(k))))


def brute_near(rows, k, percent):
    """(doc_id, shingles, component, kept) by comparing all pairs; rows of one id are one node."""
    have = [(i, sets(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in have}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(have):
        for j, t in have[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(
        [(i, len(s), find(i), find(i) == i) for i, s in have] + [(i, len(sets(t, k)), None, True) for i, t in rows if i is None], key=repr
    )


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, k, percent):
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs, k, percent).collect()), key=repr)
    assert got == brute_near(ROWS, k, percent)
    assert neardup.near_duplicates(empty, k, percent).count() == 0
    twin = neardup.near_duplicates(docs.unionByName(docs.filter("doc_id = 10").withColumn("doc_id", F.lit(None).cast("long"))), k, percent)
    assert [tuple(r)[2:] for r in twin.filter("doc_id is null").collect()] == [(None, True)] * 2
    kept = neardup.drop_near_duplicates(docs, k, percent)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, keep in got if keep}


def test_near_duplicates_of_many_edited_copies(spark):
    base = words(120, 9).split()
    rows = []
    for i in range(400):
        w = list(base)
        for j in range(i % 8):
            w[(i * 13 + j * 17) % 120] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in neardup.near_duplicates(df, 3, 85).collect()), key=repr) == brute_near(rows, 3, 85)


def test_far_signatures_that_share_keys_are_confirmed(spark):
    """A pair beyond MAX_DISTANCE whose common keys all have another hub is linked all the same."""
    import pyarrow as pa

    sketch = neardup._sketch(1)

    def signatures(texts):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
        return np.array([np.frombuffer(x, np.uint16) for out in sketch(iter([batch])) for x in out.column("sig").to_pylist()])

    for t in range(1077, 20000):
        w = [f"t{t}w{i}" for i in range(100)]
        a, b = w[:90], w[:80] + w[90:]
        x, y = signatures([" ".join(a), " ".join(b)])
        if (x != y).sum() > neardup.MAX_DISTANCE:
            break
    one = signatures(a)
    hub = sorted({a[int(np.flatnonzero(one[:, j] == x[j])[0])] for j in np.flatnonzero(x == y)})
    assert len(hub) < 0.8 * len(a)
    rows = [(1, " ".join(hub)), (2, " ".join(a)), (3, " ".join(b))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_key_guarantee():
    """Signatures within the distance always share a key."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    for _ in range(60):
        a = rng.integers(0, 1 << 16, neardup.SIZE).astype(np.uint16)
        b = a.copy()
        b[rng.choice(neardup.SIZE, neardup.MAX_DISTANCE, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], ["node", "sig"])
        assert any(r["hub"] == 1 and r["node"] == 2 for out in neardup._index_keys(iter([batch])) for r in out.to_pylist())


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (7, 7), (20, 10)] + [(i, i + 1) for i in range(100, 180)] + [(None, 1)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {k: got[k] for k in (1, 2, 3, 4, 7, 10, 11, 20)} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 10: 10, 11: 10, 20: 10}
    assert all(got[i] == 100 for i in range(100, 181)) and len(got) == 89
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, window):
    low = {}
    for i, t in rows:
        w = split(t, False)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            low[key] = min(low.get(key, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        w, gone = split(t, False), set()
        for p in range(len(w) - window + 1):
            if low[tuple(w[p : p + window])] < (math.inf if i is None else i):
                gone.update(range(p, p + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(docs, empty, spark, monkeypatch):
    got = sorted((tuple(r) for r in substrings.remove_repeats(docs).collect()), key=repr)
    assert got == brute_repeats(ROWS, 13)
    assert substrings.remove_repeats(empty).count() == 0
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"], rng.integers(0, 120)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (13, 3):
        assert sorted((tuple(r) for r in substrings.remove_repeats(df, window).collect()), key=repr) == brute_repeats(rows, window)
    texts = {r.doc_id: r.text for r in substrings.remove_repeats(df, 13, with_text=True).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()} == {i: h for i, _, _, h in brute_repeats(rows, 13)}


def test_repeats_with_split_anchors():
    """An anchor marked hot gives the same windows as one that is not."""
    import pyarrow as pa

    text = pa.array(["a b a b a c a b b a b a c a b a b c a a b c"] * 3, pa.large_string())
    for words_, ids in substrings._blocks_words([1, 2, 3], text):
        _, _, a = substrings._anchors(words_, 13)
        known = np.unique(a)
        for hot in (0, 1):
            p = substrings.Passages(words_, ids, [{"anchors": known.tobytes(), "hot": bytes([hot] * len(known))}], 13)
            covered = {(int(r), int(f) + j) for f, r, n in zip(p.first, p.row, p.n) for j in range(n)}
            assert covered == {(r, f) for f, r, _ in zip(*substrings._anchors(words_, 13))}


def test_automaton():
    rng = np.random.default_rng(1)
    for _ in range(200):
        texts = [list(rng.choice(list("ab"), rng.integers(0, 12))) for _ in range(3)]
        auto = substrings.SuffixAutomaton()
        for t in texts:
            auto.add(t)
        probe = list(rng.choice(list("abc"), 15))
        have = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max((n for n in range(1, e + 2) if tuple(probe[e + 1 - n : e + 1]) in have), default=0) for e in range(15)]
        assert auto.matching(probe) == want


def test_decontamination(docs, empty, spark):
    items = [(1, " ".join(COMMON.split()[:14])), (2, None), (3, ""), (4, "A b"), (5, words(22, 2)), (6, words(10, 1) + " not there at all"), (7, "zz yy"), (1, " ".join(COMMON.split()[:14])), (8, "One")]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))

    def brute():
        out = []
        for i, t in ROWS:
            w = split(t)
            for j, x in items:
                sh = sets(x, 5)
                if not sh:
                    continue
                m = min(5, len(next(iter(sh))))
                mine = set(zip(*(w[a:] for a in range(m)))) if len(w) >= m else set()
                both = len(sh & mine)
                if both and 100 * both >= 80 * len(sh):
                    out.append((i, j, both, len(sh)))
        return sorted(out, key=repr)

    assert sorted((tuple(r) for r in decontam.contained_items(docs, df).collect()), key=repr) == brute()
    assert decontam.contained_items(empty, df).count() == 0
    assert decontam.contained_items(docs, df.limit(0)).count() == 0
    clean = decontam.drop_contaminated(docs, df)
    assert clean.columns == docs.columns
    bad = {i for i, *_ in brute()}
    assert {r.doc_id for r in clean.collect()} >= {i for i, _ in ROWS} - bad


def test_decontamination_in_blocks(docs, spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(COMMON.split()[i : i + 8])) for i in range(9)], "item_id long, text string")
    whole = sorted(map(tuple, decontam.contained_items(docs, items).collect()))
    kept = sorted((tuple(r) for r in decontam.drop_contaminated(docs, items).collect()), key=repr)
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 3)
    assert sorted(map(tuple, decontam.contained_items(docs, items).collect())) == whole
    monkeypatch.setattr(decontam, "CHAIN", 2)
    assert sorted((tuple(r) for r in decontam.drop_contaminated(docs, items).collect()), key=repr) == kept
    assert sorted(map(tuple, decontam.contained_items(docs, items).collect())) == whole


def test_lines(docs, empty):
    got = {(r.doc_id, r.n_lines): r for r in linededup.dedup_lines(docs).collect()}
    r = got[12, 4]
    assert (r.n_removed, r.n_links, r.removed_lines, r.first_docs) == (2, 2, [2, 3], [12, 12, 12, 12])
    assert got[3, 1].n_removed == 1 and got[15, 1].n_removed == 1 and got[1, 1].n_removed == 0
    assert got[4, 1].n_removed == got[5, 1].n_removed == 0
    assert linededup.dedup_lines(empty).count() == 0
    clash = docs.withColumns({c: F.lit(c) for c in ("_id", "_gone", "_version", "_row", "version", "removed_lines")})
    cut = {r.doc_id: r.text for r in linededup.drop_duplicate_lines(clash).filter("_gone = '_gone' and _row = '_row'").collect()}
    assert cut[12] == "line one of the text is here\nshort" and cut[4] is None


def test_lines_of_two_texts_with_one_id(spark):
    """Each text of a repeated doc_id loses its own duplicate lines only."""
    rows = [(1, "alpha\nbeta\nalpha"), (2, "gamma\ngamma\ndelta"), (2, "one\ntwo\nthree\nthree"), (2, "gamma\ngamma\ndelta"), (None, "x\nx"), (None, "y\nz\nz")]
    cut = linededup.drop_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, "alpha\nbeta"), (2, "gamma\ndelta"), (2, "gamma\ndelta"), (2, "one\ntwo\nthree"), (None, "x"), (None, "y\nz")]
    assert sorted(map(tuple, cut), key=repr) == sorted(want, key=repr)


def test_hot_segments(spark, monkeypatch):
    """Many lines that share a segment lose no link when their key is split."""
    rng = np.random.default_rng(2)
    start, lines = "a common start of a line that repeats", []
    for i in range(60):
        tail = "".join(rng.choice(list("abcdefgh"), 40))
        lines += [start + tail, start + tail[:20] + "#" + tail[21:], start + tail[:5] + tail[6:]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    whole = {r.doc_id: tuple(r) for r in linededup.dedup_lines(df).collect()}
    monkeypatch.setattr(linededup, "HOT", 8)
    assert {r.doc_id: tuple(r) for r in linededup.dedup_lines(df).collect()} == whole
    links = sum(linededup.edits_within(a.encode(), b.encode()) is not None for i, a in enumerate(lines) for b in lines[:i])
    assert sum(r[3] for r in whole.values()) == 2 * links >= 240


@pytest.mark.parametrize("width", [3, 8])
def test_lines_that_differ_in_a_number(spark, monkeypatch, width):
    """A start, a middle and an end that all lines share: no link is lost, and candidates grow as the lines."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(linededup, "HOT", 16)
    met, stash = {}, linededup.stash

    def counted(df, label):
        out = stash(df, label)
        if label == "line-pairs":
            met[n] = out.count()
        return out

    monkeypatch.setattr(linededup, "stash", counted)
    for n in (150, 300):
        marks = sorted({"".join(rng.choice(list("0123456789"), width)) for _ in range(n)})
        lines = [f"every line of this log starts alike {m} and it ends alike as well" for m in marks]
        lines += ["every line of this log starts alike or does it", "an outlier: every line of this log starts alike"]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
        got = {r.doc_id: r.n_links for r in linededup.dedup_lines(df).collect()}
        near = lambda a, b: linededup.edits_within(a.encode(), b.encode()) is not None
        assert got == {i: sum(near(a, b) for j, b in enumerate(lines) if i != j) for i, a in enumerate(lines)}
    if width == 8:
        assert met[300] < 300 * 40


def test_edits_of_long_lines():
    a = b"0123456789abcdef" * 4000
    assert linededup.edits_within(a, a[:30] + a[31:50000] + b"x" + a[50000:]) == 2
    assert linededup.edits_within(a, a[:30] + a[33:]) is None


def test_edit_distance():
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(3)
    for _ in range(4000):
        a = bytes(rng.choice(list(b"abc"), rng.integers(0, 12)).astype(np.uint8))
        b = bytes(rng.choice(list(b"abc"), rng.integers(0, 12)).astype(np.uint8)) if rng.random() < 0.3 else a[: rng.integers(0, 12)] + b"c" + a[rng.integers(0, 12) :]
        limit = int(rng.integers(1, 5))
        d = lev(a, b)
        assert linededup.edits_within(a, b, limit) == (d if d <= limit else None)


def test_ids_round_trip(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for mode in ("byte", "bit"):
        got = sorted((tuple(r) for r in planes.encode_documents(docs, path, mode).collect()), key=lambda r: r[1])
        assert got == want
    assert planes.encode_documents(empty, path).count() == 0
    loose = planes.encode_documents(docs, path, ordered=False).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in loose) == Counter((i, c) for i, _, _, c in want)


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_plane_files(mode):
    import io

    rng = np.random.default_rng(0)
    docs = [(None if i == 3 else i, rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")) for i, n in enumerate((0, 1, 17, 4096, 4097, 0, 9000))]
    raw = planes.to_bytes(docs, mode, chunk=4096)
    reader = planes.PlaneReader(io.BytesIO(raw), len(raw))
    assert [(d, x.tolist()) for d, x in reader.documents()] == [(d, x.tolist()) for d, x in docs]
    every = np.concatenate([x for _, x in docs])
    assert (reader.chunk(2) == every[8192:12288]).all()
    with pytest.raises(ValueError):
        planes.PlaneReader(io.BytesIO(raw[:-1]), len(raw) - 1)
    none = planes.to_bytes([], mode)
    assert list(planes.PlaneReader(io.BytesIO(none), len(none)).documents()) == []


def test_encoder_pieces():
    rng = np.random.default_rng(5)
    enc = planes.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    letters = list("ab cZ \n.,'s'll 12é×\t\x1c²Ⅷ٣́—$_") + ["<|endoftext|>"]
    for _ in range(300):
        text = "".join(rng.choice(letters, rng.integers(0, 10)))
        assert enc.encode(text).tolist() == [*enc.tok.encode(text, add_special_tokens=False).ids, 0], repr(text)
    enc.table = planes.PieceTable(bits=4)
    for text in ("a b c d e f g h", "h g f e d c b a x y z"):
        assert enc.encode(text).tolist() == [*enc.tok.encode(text, add_special_tokens=False).ids, 0]


def test_mixing(docs, empty):
    out = mixing.mix_sources(docs, size=3.0)
    rows = out.collect()
    assert rows and [r.mix_key for r in rows] == sorted(r.mix_key for r in rows)
    assert out.columns == [*docs.columns, "mix_copy", "mix_key"]
    again = mixing.mix_sources(docs.repartition(5), size=3.0).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix_sources(empty).count() == 0
    only = {r.source for r in mixing.mix_sources(docs, {"s0": 2.0}, size=5.0).collect()}
    assert only == {"s0"}
    assert mixing.mix_sources(docs, {}).count() == 0


def test_mixing_rates(spark, monkeypatch):
    df = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("low").alias("source"))
    out = mixing.mix_sources(df, {"big": 1, "mid": 1, "low": 2}).groupBy("source").count().collect()
    for r in out:
        want = {"big": 7500, "mid": 7500, "low": 15000}[r.source]
        assert abs(r["count"] - want) < 5 * math.sqrt(want * 3)
    copies = mixing.mix_sources(df, {"big": 1, "mid": 1, "low": 2}).filter("source = 'low'").groupBy("doc_id").count().groupBy("count").count().collect()
    have = {r[0]: r[1] for r in copies}
    for k in (1, 3, 5, 8):
        p = math.exp(-5) * 5**k / math.factorial(k)
        assert abs(have.get(k, 0) - 3000 * p) < 5 * math.sqrt(3000 * p)
    whole = Counter(tuple(r) for r in mixing.mix_sources(df).select("doc_id", "mix_copy").collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 1)
    assert Counter(tuple(r) for r in mixing.mix_sources(df).select("doc_id", "mix_copy").collect()) == whole


def test_mixing_large_rates(spark, monkeypatch):
    """A rate beyond MAX_RATE is a sum of Poissons; one document may have more copies than an array holds."""
    df = spark.createDataFrame([(i, "big" if i else "one") for i in range(2000)], "doc_id long, source string").withColumn("text", F.lit("t"))
    monkeypatch.setattr(mixing, "RUN", 64)
    n = {r.source: r["count"] for r in mixing.mix_sources(df, {"one": 1, "big": 1}).groupBy("source").count().collect()}
    assert abs(n["one"] - 1000) < 5 * math.sqrt(1000) and abs(n["big"] - 1000) < 5 * math.sqrt(1000)
    copies = [r.mix_copy for r in mixing.mix_sources(df, {"one": 1, "big": 1}).filter("source = 'one'").collect()]
    assert sorted(copies) == list(range(1, n["one"] + 1))


def test_columns_of_any_name(docs, spark):
    """The caller's columns are carried whatever they are called."""
    names = ["mix_source", "mix_cdf", "mix_u", "mix_n", "mix_salt", "mix_salt_of", "row", "doc", "n", "lo", "cdf", "salt", "_gone", "_found", "_found_items", "at", "found", "_id", "node", "text2"]
    own = docs.withColumns({c: F.lit(c) for c in names})
    items = spark.createDataFrame([(1, COMMON)], "item_id long, text string")
    for fn in (lambda d: mixing.mix_sources(d, size=2.0).drop("mix_copy", "mix_key"), lambda d: neardup.drop_near_duplicates(d), lambda d: decontam.drop_contaminated(d, items)):
        out = fn(own)
        assert out.columns == own.columns
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in names)
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in fn(docs).collect())


def test_top_k(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 1 + i % 3, 6)], 1) for i in range(300)]
    rows += [(20, rows[20][1], 2), (301, None, 0), (302, [1.0, None], 0), (303, [math.nan] * 6, 0), (304, [math.inf] * 6, 0), (340, [], 0), (305, [2.0], 0), (None, [1.0] * 6, 0), (400, [0.0] * 6, 0)]
    rows += [(500 + i, [3.0] * 6, 0) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    valid = [(i, np.pad(np.floor(64 * np.array(v, float)), (0, 6 - len(v))).astype(np.int64)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, q) in enumerate(valid):
        if i % 20 == 0:
            s = sorted((-int(q @ v), j) for b, (j, v) in enumerate(valid) if b != a)[:20]
            want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id in (20, 21)")).count() == 4  # two rows of id 20, each with two candidates


def test_top_k_large_numbers(spark):
    df = spark.createDataFrame([(0, [1e9, 3.0]), (1, [1e9, 5.0]), (2, [-1e9, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df).collect()}
    assert got == {(0, 1): 64 * 10**9 * 64 * 10**9 + 192 * 320 if 64 * 10**9 * 64 * 10**9 < 2**63 else 2**63 - 1, (0, 2): max(-(2**63), -(64 * 10**9) ** 2 + 192 * 64)}


def test_urls(spark):
    rows = [
        (1, "http://www.Example.COM/en/712?x"), (2, "https://example.com/en/8"), (3, None), (4, "no scheme"), (5, "http://a.net"), (6, "http://net/de/"),
        (7, "http://example.net/de/81#f"), (8, "http://notexample.net/de/8"), (9, "x://y.org/es/://z.com/en/"), (10, "http:///path"), (11, "http://org?q/es/"), (1, "http://www.Example.COM/en/712?x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(df, url_filter.RULES).collect()}
    assert got[1] == ("www.example.com", "/en/712", "example.com/en/7", "allow")
    assert got[2] == ("example.com", "/en/8", "com/en/", "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("a.net", "", None, "allow")
    assert got[6] == ("net", "/de/", "net/de/", "allow")
    assert got[7] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[8] == ("notexample.net", "/de/8", "net/de/", "allow")
    assert got[9] == ("y.org", "/es/://z.com/en/", "org/es/", "block")
    assert got[10] == ("", "/path", None, "allow")
    assert got[11] == ("org", "", None, "allow")
    assert url_filter.filter_urls(df, url_filter.RULES).count() == len(rows)
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, [], "block").collect()} == {"block"}


def test_urls_against_every_rule(spark):
    rng = np.random.default_rng(6)
    host = lambda: ".".join(rng.choice(["a", "b", "c", "com"], rng.integers(1, 4)))
    rules = list({host() + "/" + "".join(rng.choice(list("xy/"), rng.integers(0, 3))): str(rng.choice(["allow", "block"])) for _ in range(60)}.items())
    rules.append(("/x", "block"))
    urls = [(i, "h://" + host() + "/" + "".join(rng.choice(list("xy/"), 4))) for i in range(500)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules, splits=3).collect()}
    for i, u in urls:
        h, _, p = u[4:].partition("/")
        fit = [(len(r), r, v) for r, v in rules for rh, _, rp in [r.partition("/")] if (not rh or h == rh or h.endswith("." + rh)) and ("/" + p).startswith("/" + rp)]
        assert got[i] == (max(fit)[1:] if fit else (None, "allow"))


def test_toxicity(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (9, 0, 1), (9, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(ROWS)


def test_toxicity_learns_pairs():
    """Two terms that mean something only together."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique(np.concatenate([rng.integers(100, 4000, 20), [1] * int(a), [2] * int(b)])))
        labels.append(int(a and b))
    model = toxicity.fit(rows[:1000], np.array(labels[:1000]))
    index = {t: i for i, t in enumerate(model.terms.tolist())}
    pairs = [(n, index[t]) for n, r in enumerate(rows[1000:]) for t in r.tolist() if t in index]
    score = model.scores(*np.array(pairs).T, 500)
    assert ((score >= 0.5) == np.array(labels[1000:])).mean() > 0.97
    assert np.abs(model.v).max() > 0.05


def test_toxicity_learns_pairs_of_neutral_terms():
    """Terms that say nothing apart (toxic if one of them is there alone): linear weights can't tell, the factors can."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique(np.concatenate([rng.integers(100, 4000, 20), [1] * int(a), [2] * int(b)])))
        labels.append(int(a != b))
    model = toxicity.fit(rows[:2000], np.array(labels[:2000]))
    index = {t: i for i, t in enumerate(model.terms.tolist())}
    assert {1, 2} <= set(index)
    pairs = np.array([(n, index[t]) for n, r in enumerate(rows[2000:]) for t in r.tolist() if t in index]).T
    right = lambda m: ((m.scores(*pairs, 1000) >= 0.5) == np.array(labels[2000:])).mean()
    linear = toxicity.Model(model.terms, model.bias, model.w, np.zeros_like(model.v))
    assert right(model) > 0.9 > 0.8 > right(linear)


def test_toxicity_score_by_hand(spark):
    """Scores of whole texts, computed pair by pair from the words."""
    texts = {1: "You awful GROUP-x person", 2: "a nice day, awful weather", 3: "", 4: None, 5: "person of group-x " * 300, 6: "awful awful awful"}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    import re

    import pyarrow as pa

    def buckets(text):
        words = re.findall("[a-z0-9]+", (text or "").lower())
        found = set()
        for w in words:
            block = next(toxicity.split_words(pa.array([w], pa.large_string()), True, toxicity.PUNCT))
            found |= set(toxicity._buckets(block)[1].tolist())
        return found

    terms = np.array(sorted(buckets("awful person group x weather")))
    rng = np.random.default_rng(3)
    model = toxicity.Model(terms, -0.3, rng.normal(0, 1, len(terms)), rng.normal(0, 0.5, (len(terms), toxicity.RANK)))
    got = {r.doc_id: r.tox_score for r in toxicity.score_toxicity(docs, model).collect()}
    for i, text in texts.items():
        have = [j for j, t in enumerate(terms.tolist()) if t in buckets(text)]
        z = model.bias + sum(model.w[j] for j in have) + sum(float(model.v[a] @ model.v[b]) for n, a in enumerate(have) for b in have[:n])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    hit = sum(r.toxic == r.predicted for r in rows)
    assert hit / len(rows) > 0.97
    assert sum(not r.toxic and r.predicted for r in rows) <= 0.01 * len(rows)
    # about a tenth of this table's toxic rows hold no term that any other toxic row has
    assert sum(r.toxic and r.predicted for r in rows) / sum(r.toxic for r in rows) > 0.85


def test_language_model(docs, empty):
    got = sorted((tuple(r) for r in lm.score_documents(docs).collect()), key=repr)
    tokens = [(i, split(t) + [None]) for i, t in ROWS]
    count = Counter(x for i, t in tokens if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for x in t)
    n, v = sum(count.values()), len(count)
    want = sorted(
        ((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)) for i, t in tokens), key=repr
    )
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] < 0 and math.isfinite(g[6])
    assert lm.score_documents(empty).count() == 0


def test_language_model_score_by_hand(spark, monkeypatch):
    """Whole documents scored token by token with the formulas of the gated unit and the two softmaxes."""
    import pyarrow as pa

    models, fit = [], lm.fit_rounds
    monkeypatch.setattr(lm, "fit_rounds", lambda blocks, model, n: (fit(blocks, model, n), models.append(model))[0])
    monkeypatch.setattr(lm, "VOCABULARY", 70)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(words[min(int(rng.pareto(1.0) * 3), 119)] for _ in range(int(rng.integers(0, 90)))) for i in range(40)} | {40: None, 41: "W1 never seen W1"}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    model, counts = models[0], Counter()
    par = {k: v.astype(np.float64) for k, v in model.par.items()}
    for i, t in texts.items():
        if not lm.is_held_out(i):
            counts.update((t or "").lower().split())
    sig, hidden = lambda x: 1 / (1 + np.exp(-x)), lm.HIDDEN
    for i, t in texts.items():
        ids = model.encode(lm._tokens(pa.array([t or ""], pa.large_string()))[0])
        h, before, total = np.zeros(hidden), len(par["x"]) - 1, 0.0
        for word, y in zip([*(t or "").lower().split(), None], ids.tolist()):
            g, s = par["x"][before], h @ par["u"]
            z, r = sig(g[:hidden] + s[:hidden]), sig(g[hidden : 2 * hidden] + s[hidden : 2 * hidden])
            h = z * h + (1 - z) * np.tanh(g[2 * hidden :] + r * s[2 * hidden :])
            kind, own = divmod(y, lm.CLASS_WORDS)
            a, b = h @ par["wc"] + par["bc"], h @ par["ww"][kind] + par["bw"][kind]
            total += (a[kind] - np.log(np.exp(a).sum()) + b[own] - np.log(np.exp(b).sum())) / np.log(10)
            if y == model.other:
                total += math.log10((counts[word] + 1) / (model.rest_n + model.rest_v + 1))
            before = y
        assert got[i] == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_gradient():
    rng = np.random.default_rng(1)
    par = {k: v.astype(np.float64) for k, v in lm.new_parameters(70, 5).items()}
    h, y = rng.normal(0, 1, (9, 5)), rng.integers(0, 70, 9)
    grad = {k: np.zeros_like(v) for k, v in par.items()}
    lm._output(par, h, y, grad)
    for name, at in (("wc", (2, 1)), ("bc", (0,)), ("ww", (0, 3, 7)), ("bw", (1, 2))):
        e = np.zeros_like(par[name])
        e[at] = 1e-6
        up, down = ({**par, name: par[name] + s * e} for s in (1, -1))
        slope = (lm._output(up, h, y).sum() - lm._output(down, h, y).sum()) / 2e-6
        assert slope == pytest.approx(-grad[name][at], abs=1e-5)


def test_lanes_do_not_change_scores():
    rng = np.random.default_rng(2)
    par = lm.new_parameters(70, 8)
    size = rng.integers(1, 90, 40)
    bounds = np.concatenate([[0], np.cumsum(size)])
    ids = rng.integers(0, 70, bounds[-1]).astype(np.int32)
    whole = lm.log_likelihood(par, ids, bounds, 16)
    alone = [lm.log_likelihood(par, ids[a:b], np.array([0, b - a]), 1)[0] for a, b in zip(bounds[:-1], bounds[1:])]
    assert np.allclose(whole, alone, rtol=1e-4)


def test_distribution_sums_to_one():
    par = {k: v.astype(np.float64) for k, v in lm.new_parameters(128, 8).items()}
    h = np.random.default_rng(3).normal(0, 1, (1, 8))
    assert sum(np.exp(lm._output(par, h, np.array([y]))[0]) for y in range(128)) == pytest.approx(1)


def test_recurrent_model_learns_order():
    """After each word of a cycle the next is certain; counts alone can't tell."""
    ids = np.tile(np.arange(6), 400).astype(np.int32)
    bounds = np.arange(0, len(ids) + 1, 120)
    par = lm.train(lm.new_parameters(6, 16), ids, bounds, epochs=60, lanes=8)
    assert lm.log_likelihood(par, ids, bounds).sum() / len(ids) > -0.2


def test_language_model_learns_from_every_document(spark):
    """Only documents beyond the first 800 in order of their hash show the order of the words."""
    ids = [r.id for r in spark.range(2600).orderBy(F.xxhash64("id"), "id").collect()]
    first = set([i for i in ids if not lm.is_held_out(i)][:800])
    rng = np.random.default_rng(4)
    cycle = [f"w{j % 8}" for j in range(40)]
    rows = [(i, " ".join(rng.permutation(cycle) if i in first else cycle)) for i in ids]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).filter("held_out")
    r = got.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert r.score > 0.5 * r.base


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, sf)
        if name != "token_ids":
            assert kept.columns == docs.columns
            kept = corpus_pipeline.stash(kept, name)
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "near_dedup":
            inside = sorted((r.doc_id, r.text) for r in before.collect())
            assert ids == {i for i, _, _, keep in brute_near(inside, 5, 80) if keep}
        if name == "decontamination":
            items = [sets(r.text, 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            clean = {i for i in {r.doc_id for r in before.collect()} if not any(100 * len(x & sets(rows[i], 5)) >= 80 * len(x) for x in items if x)}
            assert ids == clean
        if name == "mixing":
            mixed = Counter(r.doc_id for r in kept.collect())
    assert Counter(r.doc_id for r in kept.collect()) == mixed
    assert corpus_pipeline.run(spark, sf).count() == sum(mixed.values())
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), sf).count()
