"""Work that must grow with the corpus and not with its square."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from cidrloom.llm import blocks, linededup, lm, neardup, planes, substrings

from .test_edges import brute_near, brute_repeats


def block_rows(n):
    """``n`` blocks of one file, of one text each."""
    rows = [[(3 << 24) + i for i in range(n)], [[i] for i in range(n)], [[" ".join(f"w{j}" for j in range(i, i + 400))] for i in range(n)]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, blocks._SCHEMA.types)], schema=blocks._SCHEMA)


def test_counts_are_sent_by_groups_of_blocks():
    sent = pa.Table.from_batches(lm._send_counts(16)(iter([block_rows(40)])))
    assert sent.num_rows <= 16 * 3
    assert sum(np.frombuffer(x, np.uint32).sum() for x in sent.column("counts").to_pylist()) == sum(401 for i in range(40) if not lm.is_held_out(i))


def test_vocabulary_lookup():
    rng = np.random.default_rng(0)
    vocab = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.uint64((1 << 64) - 1) - np.arange(3, dtype=np.uint64)]))
    model = lm.Model(vocab, rng.permutation(len(vocab)).astype(np.int32), {}, 0, 0)
    h = np.concatenate([vocab, vocab + np.uint64(1), vocab - np.uint64(1), [lm.END], rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    code = dict(zip(vocab.tolist(), model.code.tolist())) | {int(lm.END): len(vocab) + 1}
    assert model.encode(h).tolist() == [code.get(x, len(vocab)) for x in h.tolist()]
    assert lm.Model(vocab[:0], model.code[:0], {}, 0, 0).encode(np.array([5, lm.END], np.uint64)).tolist() == [0, 1]


@pytest.mark.parametrize("skew", [1.0, 3.0])
def test_classes_of_few_rows_together(skew, monkeypatch):
    rng = np.random.default_rng(1)
    par = {k: v.astype(np.float64) for k, v in lm.new_parameters(1000, 6).items()}
    h, y = rng.normal(0, 0.4, (3000, 6)), (1000 * rng.random(3000) ** skew).astype(np.int32)
    got = []
    for few in (lm.FEW, 0):
        monkeypatch.setattr(lm, "FEW", few)
        grad = {k: np.zeros_like(v) for k, v in par.items()}
        got.append({"p": lm._output(par, h, y, grad), **grad})
    for k in got[0]:
        assert np.allclose(got[0][k], got[1][k], rtol=0, atol=1e-10), k


def test_anchors_are_sent_by_groups_of_blocks():
    sent = pa.Table.from_batches(substrings._send_anchors(16, 13)(iter([block_rows(40)])))
    assert sent.num_rows <= 16 * 3


def test_repeats_between_blocks_of_a_group(spark):
    """Passages shared by texts of other blocks, and pieces of one index in several blocks."""
    rng = np.random.default_rng(7)
    shared = [" ".join(f"s{k}x{j}" for j in range(40)) for k in range(12)]
    rows = []
    for i in range(36):
        own = [f"d{i}x{j}" for j in range(16000)]
        for k in rng.choice(12, 5, replace=False):
            own.insert(int(rng.integers(0, 16000)), shared[k])
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    assert blocks.make_blocks(df).count() > 3
    assert sorted((tuple(r) for r in substrings.remove_repeats(df).collect()), key=repr) == brute_repeats(rows, 13)


def test_template_texts_are_told_from_links_by_counts(spark, monkeypatch):
    """Documents that share two thirds of their text share keys, but their texts are not compared; links stay."""
    asked, confirm = [], neardup.confirm_links

    def counted(docs, pairs, *rest):
        asked.append(pairs.count())
        return confirm(docs, pairs, *rest)

    monkeypatch.setattr(neardup, "confirm_links", counted)
    template = " ".join(f"t{j}" for j in range(260))
    rows = [(i, template + " " + " ".join(f"d{i}x{j}" for j in range(140))) for i in range(150)]
    rows += [(1000 + i, t.replace(f"d{i}x77", "other")) for i, t in rows[:40]]  # one word changed
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (neardup.KEY_BLOCK, 16):
        asked.clear()
        monkeypatch.setattr(neardup, "KEY_BLOCK", size)
        got = sorted((tuple(r) for r in neardup.near_duplicates(df, 3, 85).collect()), key=repr)
        assert got == brute_near(rows, 3, 85)
        assert 40 <= sum(asked) < 200


def test_counts_lose_no_link():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 85, 100):
        for size in (1, 20, 300, 60000):
            a = set(rng.integers(0, 1 << 30, size).tolist())
            most = len(a) * (100 - percent) // (100 + percent)
            gone = set(list(a)[:most])
            b = (a - gone) | {-1 - i for i in range(most // 2)}
            assert 100 * len(a & b) >= percent * len(a | b)
            x, y = (np.bincount([v % neardup.RANGES for v in s], minlength=neardup.RANGES).astype(np.uint8)[None] for s in (a, b))
            assert neardup.may_link(x, y, np.array([len(a) + len(b)]), percent)[0]


def test_new_pieces_go_to_the_library_together():
    """Calls of the library grow with the bytes of new pieces, not with their number."""
    enc = planes.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    tok, asked = enc.tok, []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            asked.extend(texts)
            return tok.encode_batch_fast(texts, **kw)

    enc.tok = Counted()
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghäß,.'<|>éж汉1"), rng.integers(1, 12))) for _ in range(6000)]
    text = " ".join(w + "\n" + w for w in words)
    got = enc.encode(text).tolist()
    assert got == [*tok.encode(text, add_special_tokens=False).ids, 0]
    assert len(asked) < 30
    enc.newline, enc.table = None, planes.PieceTable()  # a library that gives no id of its own to a newline
    assert enc.encode(text).tolist() == got
    assert len(asked) > 6000


def test_odd_white_space_is_found_without_reading_every_text():
    texts = ["", "a b", " a", "a ", "a  b", "a\n b", "a\tb", "a b", "a\u0085b", "a b", "a　b", "a﻿b", "a᠎b", "a b", "a\x1fb", "\n", "ä\nö", "a’s", "é"]
    every = [*texts, "".join(chr(c) for c in range(0x80, 0x100) if not chr(c).isspace())] + [f"x{chr(c)}y" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    for some in (every, every[::-1], every[1::3]):
        col = pa.array(some, pa.large_string())
        data = np.frombuffer("".join(some).encode(), np.uint8)
        assert planes._odd_rows(col, data).tolist() == [bool(planes._ODD.search(t)) for t in some]


def test_lines_that_share_a_segment_are_told_apart_by_sketches(spark, monkeypatch):
    """Lines that share a third of their bytes, but are no links, give no candidates, in hot keys neither; links stay."""
    rng = np.random.default_rng(13)
    seen, stash = {}, linededup.stash

    def counted(df, label):
        out = stash(df, label)
        if label in ("line-pairs", "rests"):
            seen[label] = out.count()
        return out

    monkeypatch.setattr(linededup, "stash", counted)
    lines = ["a common start " + "".join(rng.choice(list("etaoin shrdlu"), 27)) + str(i % 7) + "." for i in range(400)]
    lines += [x[:20] + "#" + x[21:] for x in lines[:30]] + [x[:30] + x[31:] for x in lines[30:60]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    near = [sum(linededup.edits_within(a.encode(), b.encode()) is not None for j, b in enumerate(lines) if i != j) for i, a in enumerate(lines)]
    for hot in (linededup.HOT, 64):
        seen.clear()
        monkeypatch.setattr(linededup, "HOT", hot)
        assert {r.doc_id: r.n_links for r in linededup.dedup_lines(df).collect()} == dict(enumerate(near))
        assert 60 <= seen["line-pairs"] < 400 and "rests" not in seen


def test_sketches_lose_no_link():
    rng = np.random.default_rng(17)
    for size in (24, 70, 400, 5000):
        for letters in (list(b"ab"), list(range(256))):
            a = rng.choice(letters, size).astype(np.uint8).tobytes()
            for _ in range(60):
                b = bytearray(a)
                for _ in range(linededup.TAU):
                    at, c = int(rng.integers(0, len(b))), bytes([rng.choice(letters)])
                    b[at : at + int(rng.integers(0, 2))] = c if rng.random() < 0.7 else b""
                x, y = (linededup.sketches(np.frombuffer(bytes(t), np.uint8), np.array([0]), np.array([len(t)])) for t in (a, b))
                assert linededup.may_be_near(x, y)[0] and linededup.may_be_near(y, x)[0]
