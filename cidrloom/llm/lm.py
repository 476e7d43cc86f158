"""Operator 6: document log-likelihood under a gated recurrent language model.

Counts of every word of the training documents are gathered from the whole
corpus: groups of blocks of texts send their different words' hashes with
counts, by hash bucket, and get the corpus counts of those words back. They give the base score
and the vocabulary of the recurrent model, the ``VOCABULARY`` most frequent
words and one class for all others, within which a word has its share of the
counts (plus one) of all others, so rare words carry corpus-wide statistics too.

The recurrent part is a gated recurrent unit whose output softmax is factored
into classes of words of like frequency. It is trained by truncated
backpropagation in numpy over every token of every training document: in each
of ``ROUNDS`` rounds, each over its share of the blocks, all tasks start from
the same parameters and learn from their part of it, and the results are averaged by tokens, a piece
of the parameters at a time. A corpus under ``LEAST_TOKENS`` tokens is gone over
again, up to ``MOST_PASSES`` times. The model's size does not depend on the
corpus, and it is broadcast; its last digits depend on how rows lie in files.
For scoring, documents fill the lanes of a batch one after the other, each from
an empty state, and states are carried from window to window, so that any
document is scored as a whole.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SideReader, by_bucket, each_block, each_group, make_blocks, write_side
from .textwords import split_words, text_column
from .workspace import partitions, stash

VOCABULARY = 4094
CLASS_WORDS = 64
HIDDEN = 24
ROUNDS = 4
LEAST_TOKENS = 1_000_000
MOST_PASSES = 3
#: Tokens that a task lays out in lanes at once to learn from, and pieces of the parameters that are averaged apart.
TRAIN_TOKENS = 1 << 20
PIECES = 16
WINDOW = 32
RUN = 4096
LANES = 1024
POOL_TOKENS = 3_000_000
END = np.uint64(0xE7037ED1A0B428DB)
#: Bytes of text that are hashed at once, so that their sums stay in the processor's cache.
PIECE = 1 << 17
#: Leading bits of a hash by which the vocabulary is looked up.
_LEAD = 18


def is_held_out(doc_id: int | None, fold: int = 7, rest: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % fold == rest


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and where each text's tokens start."""
    hashes, bounds, at = [], [np.zeros(1, np.int64)], 0
    for words in split_words(texts, True, max_bytes=PIECE):
        docs = words.hi - words.lo
        row = np.repeat(np.arange(docs), np.diff(words.bounds))
        out = np.full(len(words.start) + docs, END, np.uint64)
        out[np.arange(len(row)) + row] = words.hashes()
        hashes.append(out)
        bounds.append(at + words.bounds[1:] + np.arange(1, docs + 1))
        at += len(out)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(bounds)


def _by_bucket_order(u: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, buckets present, start and end of each in the order) of sorted distinct hashes."""
    b = (u % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b = b[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    return order, b[cut], cut, np.append(cut[1:], len(b))[: len(cut)]


def _send_counts(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, blocks in each_group(batches):
            words, counts = [], []
            for _, ids, texts in blocks:
                h, bounds = _tokens(texts)
                learn = np.repeat([not is_held_out(i) for i in ids], np.diff(bounds))
                u, count = np.unique(h[learn], return_counts=True)
                words += [u, np.unique(h[~learn])]
                counts += [count, np.zeros(len(words[-1]), np.int64)]
            u, inverse = np.unique(np.concatenate(words), return_inverse=True)
            count = np.bincount(inverse, np.concatenate(counts), len(u)).astype(np.uint32)
            order, names, lo, hi = _by_bucket_order(u, buckets)
            packed = [[x[order[a:b]].tobytes() for a, b in zip(lo, hi)] for x in (u, count)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(np.full(len(names), group)), *(pa.array(x, pa.binary()) for x in packed)], schema=schema)

    return run


def _sum_counts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """A group's words in a bucket and their corpus counts; and, under block -1, the bucket's totals and top words."""
    hashes = table.column("hashes").to_pylist()
    size = np.array([len(x) // 8 for x in hashes])
    u, inverse = np.unique(np.frombuffer(b"".join(hashes), np.uint64), return_inverse=True)
    total = np.bincount(inverse, np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32), len(u)).astype(np.int64)
    back, ends = total[inverse].astype("<u8"), np.cumsum(size)
    bucket = table.column("bucket")[0].as_py()
    rows = [back[e - n : e].astype("<u4" if total.max(initial=0) < 1 << 32 else "<u8").tobytes() for n, e in zip(size, ends)]
    top = np.lexsort((u, -total))[: VOCABULARY + 1]
    top = top[total[top] > 0]
    n = len(rows)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(table.column("block").to_numpy(), -1)),
            pa.array([bucket] * (n + 1), pa.int32()),
            pa.array([*rows, total[top].tobytes()], pa.binary()),
            pa.array([*hashes, u[top].tobytes()], pa.binary()),
            pa.array([0] * n + [int(total.sum())], pa.int64()),
            pa.array([0] * n + [int((total > 0).sum())], pa.int64()),
        ],
        ["block", "bucket", "counts", "hashes", "n", "v"],
    )


def _unpack_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t, c in zip(b.column("hashes").to_pylist(), b.column("counts").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["hash", "c"])


@dataclass
class Model:
    """vocab: sorted hashes; code: id of each; ids of the others, the end and the start follow."""

    vocab: np.ndarray
    code: np.ndarray
    par: dict[str, np.ndarray]
    rest_n: int  # tokens and different words outside the vocabulary
    rest_v: int

    @property
    def other(self) -> int:
        return len(self.vocab)

    @functools.cached_property
    def _lookup(self) -> tuple[np.ndarray, int]:
        """The first word at or after each value of the leading bits, and the most words that share one."""
        at = np.searchsorted(self.vocab >> np.uint64(64 - _LEAD), np.arange((1 << _LEAD) + 1))
        return at[:-1].astype(np.int32), int(np.diff(at).max())

    def encode(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.other, np.int32)
        if len(self.vocab):
            first, most = self._lookup
            at = first[h >> np.uint64(64 - _LEAD)]
            for j in range(most):
                here = np.minimum(at + j, len(self.vocab) - 1)
                hit = self.vocab[here] == h
                out[hit] = self.code[here[hit]]
        out[h == END] = self.other + 1
        return out


def new_parameters(size: int, hidden: int, seed: int = 6) -> dict[str, np.ndarray]:
    """``size``: words, other and end. Rows of x: the gates' input for each previous token and the start."""
    rng = np.random.default_rng(seed)
    classes = -(-size // CLASS_WORDS)
    small = lambda *s: rng.normal(0, 0.08, s).astype(np.float32)
    return {
        "x": small(size + 1, 3 * hidden),
        "u": small(hidden, 3 * hidden),
        "wc": small(hidden, classes),
        "bc": np.zeros(classes, np.float32),
        "ww": small(classes, hidden, CLASS_WORDS),
        "bw": np.zeros((classes, CLASS_WORDS), np.float32),
    }


#: Rows of logits that are worked on at once, so that they stay in the processor's cache.
CHUNK = 2048
#: Rows up to which classes are worked on together, to spare calls.
FEW = 256
#: Logits within this bound can't overflow, so their largest needn't be taken off first.
_SAFE = 60.0


@functools.cache
def _ones(n: int, kind: np.dtype) -> np.ndarray:
    return np.ones(n, kind)


def _gates(par: dict, x: np.ndarray) -> np.ndarray:
    """Input of the gates (steps, 3 * hidden, lanes) of previous tokens (steps, lanes)."""
    return np.ascontiguousarray(np.take(par["x"], x, 0).transpose(0, 2, 1))


def _step(u: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New state and what the state adds to the gates; ``u`` (3 * hidden, hidden), states (hidden, lanes).

    ``g`` holds the gates' input and becomes their output: keep, reset, new.
    """
    n = len(h)
    hu = u @ h
    zr, new = g[: 2 * n], g[2 * n :]
    zr += hu[: 2 * n]
    np.negative(zr, zr)
    np.exp(zr, zr)
    zr += 1
    np.reciprocal(zr, zr)
    new += hu[2 * n :] * zr[n:]
    np.tanh(new, new)
    out = h - new
    out *= zr[:n]
    out += new
    return out, hu[2 * n :]


def _places(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Flat index of column ``at`` of each row."""
    return np.arange(0, table.size, table.shape[1]) + at


def _log_softmax_at(logits: np.ndarray, own: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of the flat places ``own``, sum) of each row; ``logits`` become the exponentials that sum to it."""
    if not safe:
        logits -= logits.max(1, keepdims=True)
    mine = logits.ravel()[own]
    np.exp(logits, logits)
    total = logits @ _ones(logits.shape[1], logits.dtype)
    return mine - np.log(total), total


def _with_bias(weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The bias as the weights of one more input, which is 1."""
    return np.concatenate([weight, bias[..., None, :]], -2)


def _output(par: dict, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> np.ndarray:
    """Log-probability of each target after states ``h`` (rows); adds to ``grad`` and sets its ``h`` if given."""
    kind = y // CLASS_WORDS
    order = np.argsort(kind.astype(np.uint16), kind="stable")
    rows_in, kind, own = np.ones((len(h), h.shape[1] + 1), h.dtype), kind[order], (y % CLASS_WORDS)[order]
    rows_in[:, :-1] = np.take(h, order, 0)
    cut = np.searchsorted(kind, np.arange(len(par["bc"]) + 1))
    # states lie between -1 and 1
    safe = float(max((np.abs(par["wc"]).sum(0) + np.abs(par["bc"])).max(), (np.abs(par["ww"]).sum(1) + np.abs(par["bw"])).max())) < _SAFE
    logp, dh = np.empty(len(y), h.dtype), None if grad is None else np.empty_like(h)
    wc, ww = _with_bias(par["wc"], par["bc"]), _with_bias(par["ww"], par["bw"])
    dc, dw = (None, None) if grad is None else (np.zeros_like(wc), np.zeros_like(ww))

    def descend(p: np.ndarray, total: np.ndarray, at: np.ndarray, rows: np.ndarray, slope: np.ndarray) -> np.ndarray:
        p.ravel()[at] -= total
        each = (1 / total)[:, None]
        slope += (rows * each).T @ p
        return each

    for lo in range(0, len(y), CHUNK):
        rows = rows_in[lo : lo + CHUNK]
        p = rows @ wc
        at = _places(p, kind[lo : lo + CHUNK])
        logp[lo : lo + CHUNK], total = _log_softmax_at(p, at, safe)
        if grad is not None:
            each = descend(p, total, at, rows, dc)
            np.multiply(p @ par["wc"].T, each, out=dh[lo : lo + CHUNK])
    own = own + np.arange(0, len(own) * CLASS_WORDS, CLASS_WORDS)
    cut = cut.tolist()
    for c, (first, last) in enumerate(zip(cut, cut[1:])):
        for lo in range(first, last if last - first > FEW else first, CHUNK):
            hi = min(lo + CHUNK, last)
            rows = rows_in[lo:hi]
            q = rows @ ww[c]
            at = own[lo:hi] - lo * CLASS_WORDS
            more, total = _log_softmax_at(q, at, safe)
            logp[lo:hi] += more
            if grad is not None:
                each = descend(q, total, at, rows, dw[c])
                more = q @ par["ww"][c].T
                more *= each
                dh[lo:hi] += more
    start, size = np.array(cut[:-1]), np.diff(cut)
    few = np.flatnonzero((size > 0) & (size <= FEW))
    few = few[np.argsort(size[few], kind="stable")]
    while len(few):  # classes of few rows at once, filled up to the largest of them
        cs = few[: np.searchsorted(size[few], max(8, size[few[0]] * 3 // 2), "right")]
        few = few[len(cs) :]
        here = np.arange(size[cs[-1]]) < size[cs, None]
        at = np.minimum(start[cs, None] + np.arange(here.shape[1]), len(y) - 1)
        rows, mine = np.take(rows_in, at, 0), at[here]
        q = rows @ ww[cs]
        if not safe:
            q -= q.max(2, keepdims=True)
        place = np.arange(0, q.size, CLASS_WORDS).reshape(at.shape)[here] + (own[mine] - mine * CLASS_WORDS)
        picked = q.ravel()[place]
        np.exp(q, q)
        total = q @ _ones(CLASS_WORDS, q.dtype)
        logp[mine] += picked - np.log(total[here])
        if grad is not None:
            q.ravel()[place] -= total[here]
            each = (here / total).astype(q.dtype)[:, :, None]
            dw[cs] = (rows * each).transpose(0, 2, 1) @ q
            dh[mine] += ((q @ par["ww"][cs].transpose(0, 2, 1)) * each)[here]
    out = np.empty_like(logp)
    out[order] = logp
    if grad is not None:
        for k, d in (("c", dc), ("w", dw)):
            grad[f"w{k}"] += d[..., :-1, :]
            grad[f"b{k}"] += d[..., -1, :]
        grad["h"] = np.empty_like(dh)
        grad["h"][order] = dh
    return out


def fill_lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Spread documents over lanes of about equal length, long ones first."""
    lengths = lengths.tolist()
    n = max(1, min(most, len(lengths), sum(lengths) // max(1, max(lengths, default=1))))
    heap, lanes = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        size, lane = heapq.heappop(heap)
        lanes[lane].append(d)
        heapq.heappush(heap, (size + lengths[d], lane))
    return lanes


def _lay_out(ids: np.ndarray, bounds: np.ndarray, most: int, start: int | np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens, inputs, first-token marks, document), each steps x lanes; document -1 is padding.

    ``start`` is the input before the first token, of all documents or of each.
    """
    lengths = np.diff(bounds)
    lanes = fill_lanes(lengths, most)
    # Lanes in descending order of length: those still running are always the first.
    lanes.sort(key=lambda l: -int(lengths[l].sum()))
    longest = max((int(lengths[l].sum()) for l in lanes), default=0)
    y = np.zeros((longest, len(lanes)), np.int32)
    doc = np.full((longest, len(lanes)), -1, np.int32)
    fresh = np.zeros((longest, len(lanes)), bool)
    for i, lane in enumerate(lanes):
        at = 0
        for d in lane:
            n = int(lengths[d])
            y[at : at + n, i] = ids[bounds[d] : bounds[d + 1]]
            doc[at : at + n, i] = d
            fresh[at : at + 1, i] = True
            at += n
    x = np.empty_like(y)
    x[1:] = y[:-1]
    x[fresh] = start if np.ndim(start) == 0 else start[doc[fresh]]
    return y, x, fresh, doc


def cut_runs(ids: np.ndarray, bounds: np.ndarray, start: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, input before each) of documents cut into runs of at most ``run`` tokens."""
    size = np.diff(bounds)
    n = np.maximum(1, -(-size // run))
    first = np.repeat(bounds[:-1], n) + run * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    before = np.where(np.isin(first, bounds[:-1]), start, ids[np.maximum(first - 1, 0)] if len(ids) else start)
    return np.append(first, bounds[-1:]), before.astype(np.int32)


def train(par: dict, ids: np.ndarray, bounds: np.ndarray, epochs: int = 3, lanes: int = 48, rate: float = 0.01, fall: float = 0.9, moments: dict | None = None) -> dict:
    """Truncated backpropagation over windows, with the state carried between them.

    A document of more than RUN tokens is learned from in runs of so many, which
    start from an empty state after the token before, so that long documents
    don't keep few lanes busy. The rate falls by ``fall`` of itself; ``moments`` carries the optimizer's state from call to call.
    """
    hidden, start = len(par["u"]), len(par["x"]) - 1
    bounds, before = cut_runs(ids, bounds, start, RUN)
    y, x, fresh, doc = _lay_out(ids, bounds, lanes, before)
    moments = new_moments(par) if moments is None else moments
    own, moved = par, [_joined(d) for d in (par, moments["first"], moments["second"], par)]
    par, grad = moved[0][1], moved[3][1]
    spare = np.empty(min(STEP, len(moved[0][0])), moved[0][0].dtype)
    done, total = 0, epochs * -(-len(y) // WINDOW)
    for _ in range(epochs):
        h = np.zeros((hidden, y.shape[1]), par["u"].dtype)
        for lo in range(0, len(y), WINDOW):
            hi = min(lo + WINDOW, len(y))
            for k in ("wc", "bc", "ww", "bw", "u", "x"):
                grad[k].fill(0)
            gates, keep, anew = _gates(par, x[lo:hi]), (~fresh[lo:hi]).astype(h.dtype), fresh[lo:hi].any(1)
            states, was, added = (np.empty((hi - lo, *h.shape), h.dtype) for _ in range(3))
            u = np.ascontiguousarray(par["u"].T)
            for s in range(hi - lo):
                np.multiply(h, keep[s], out=was[s])
                states[s], added[s] = _step(u, was[s], gates[s])
                h = states[s]
            mask = (doc[lo:hi] >= 0).ravel()
            flat = np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, hidden)
            n, whole = max(1, int(mask.sum())), bool(mask.all())
            _output(par, flat if whole else flat[mask], y[lo:hi].ravel() if whole else y[lo:hi].ravel()[mask], grad)
            if whole:
                dout = grad.pop("h")
            else:
                dout = np.zeros_like(flat)
                dout[mask] = grad.pop("h")
            for k in ("wc", "bc", "ww", "bw"):
                grad[k] /= n
            dout /= n
            dout = np.ascontiguousarray(dout.reshape(hi - lo, -1, hidden).transpose(0, 2, 1))
            # what a state's gradient is multiplied by to get that of each gate's input, for the whole window
            z, r, new = (gates[:, k * hidden : (k + 1) * hidden] for k in range(3))
            pull = np.empty_like(gates)
            grow = np.multiply(new, new)
            np.subtract(1, grow, out=grow)
            grow *= 1 - z
            through = grow * r
            np.multiply(through, added, out=pull[:, hidden : 2 * hidden])
            pull[:, hidden : 2 * hidden] *= 1 - r
            np.subtract(was, new, out=pull[:, :hidden])
            pull[:, :hidden] *= z
            pull[:, :hidden] *= 1 - z
            pull[:, 2 * hidden :] = through
            dh, by_gate = np.zeros_like(h), pull.reshape(hi - lo, 3, hidden, -1)
            for s in reversed(range(hi - lo)):
                d = dout[s]
                d += dh
                by_gate[s] *= d
                dh = par["u"] @ pull[s]
                dh += d * z[s]
                if anew[s]:
                    dh *= keep[s]
            grad["u"] += np.matmul(was, pull.transpose(0, 2, 1)).sum(0)
            np.multiply(dout, grow, out=pull[:, 2 * hidden :])
            words = x[lo:hi].ravel()
            order = np.argsort(words.astype(np.uint16) if start < 1 << 16 else words, kind="stable")
            words = words[order]
            cut = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            rows = np.ascontiguousarray(pull.transpose(0, 2, 1)).reshape(-1, 3 * hidden)
            grad["x"][words[cut]] = _sum_runs(rows, order, cut)
            done += 1
            moments["t"] += 1
            t = moments["t"]
            norm = np.sqrt(float(np.vdot(moved[3][0], moved[3][0])))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            lr = rate * (1 - fall * done / total) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for at in range(0, len(moved[0][0]), STEP):
                p, first, second, g = (flat[at : at + STEP] for flat, _ in moved)
                old = spare[: len(g)]
                g *= scale
                np.subtract(g, first, old)
                old *= 0.1
                first += old
                g *= g
                g -= second
                g *= 0.001
                second += g
                np.sqrt(second, g)
                g += 1e-8
                np.divide(first, g, g)
                g *= lr
                p -= g
    for d, (_, views) in zip((own, moments["first"], moments["second"]), moved):
        for k, v in views.items():
            d[k][...] = v
    return own


def _sum_runs(rows: np.ndarray, order: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``rows[order]`` that start at ``cut``: short runs row by row for all at once."""
    size = np.diff(cut, append=len(order))
    out = np.empty((len(cut), rows.shape[1]), rows.dtype)
    for i in np.flatnonzero(size > 16).tolist():
        np.add.reduce(np.take(rows, order[cut[i] : cut[i] + size[i]], 0), 0, out=out[i])
    short = np.flatnonzero(size <= 16)
    short = short[np.argsort(-size[short], kind="stable")]
    at, left = cut[short], -size[short]
    total = np.take(rows, order[at], 0)
    for r in range(1, -int(left.min(initial=0))):
        n = int(np.searchsorted(left, -r))
        total[:n] += np.take(rows, order[at[:n] + r], 0)
    out[short] = total
    return out


#: Parameters that a step of the optimizer works on at once, so that they stay in the processor's cache.
STEP = 1 << 15


def _joined(d: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A copy of all arrays in one, and each of them as a view of it."""
    flat, views, at = np.concatenate([v.ravel() for v in d.values()]), {}, 0
    for k, v in d.items():
        views[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return flat, views


def new_moments(par: dict) -> dict:
    return {"t": 0, **{m: {k: np.zeros_like(v) for k, v in par.items()} for m in ("first", "second")}}


def _learn(shared, turn: int, rounds: int):
    """One round: each task's parameters and moments, in pieces, after its documents of this turn."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("steps", pa.int64()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, moments = shared.value
        par = {k: v.copy() for k, v in model.par.items()}
        moments = {"t": moments["t"], **{m: {k: v.copy() for k, v in moments[m].items()} for m in ("first", "second")}}
        pool, held, seen = [], 0, 0

        def fit() -> None:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in pool]))])
            # about as many windows a round in small corpora as in large ones
            lanes = min(256, max(48, held // 4096))
            train(par, np.concatenate([x for x, _ in pool]), bounds, 1, lanes, 0.01 * (1 - 0.9 * (turn + 0.5) / rounds), 0.0, moments)

        for _, docs, texts in each_block(batches):
            mine = [j for j, i in enumerate(docs) if not is_held_out(i)]
            if not mine:
                continue
            h, bounds = _tokens(texts.take(pa.array(mine)))
            pool.append((model.encode(h), np.diff(bounds)))
            held, seen = held + len(h), seen + len(h)
            if held >= TRAIN_TOKENS:
                fit()
                pool, held = [], 0
        if pool:
            fit()
        if seen:
            pieces = [x.tobytes() for x in np.array_split(_flat(par, moments), PIECES)]
            same = [np.full(PIECES, v) for v in (TaskContext.get().partitionId(), seen, moments["t"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([np.arange(PIECES), *same, pieces], schema.types)], schema=schema)

    return run


def _flat(par: dict, moments: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for d in (par, moments["first"], moments["second"]) for v in d.values()])


def _average(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """A piece's mean over the tasks, weighted by their tokens."""
    table = table.sort_by("part")
    n = table.column("n").to_numpy()
    total = 0.0
    for w, raw in zip(n / n.sum(), table.column("values")):
        total = total + w * np.frombuffer(raw.as_py(), np.float32)
    row = [table.column("bucket")[:1].to_pylist(), [int(n.sum())], [int(table.column("steps").to_numpy().max())], [total.astype(np.float32).tobytes()]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["bucket", "n", "steps", "values"])


def fit_rounds(blocks: DataFrame, model: Model, n_all: int) -> int:
    """Train ``model`` on all tokens of the training documents; how many it learned from, each pass counted."""
    spark = blocks.sparkSession
    passes = min(MOST_PASSES, max(1, -(-LEAST_TOKENS // max(1, n_all))))
    # a task learns from many blocks in a row, and what is averaged doesn't grow with the corpus
    tasks = blocks.coalesce(2 * spark.sparkContext.defaultParallelism)
    moments, learned = new_moments(model.par), 0
    for turn in range(ROUNDS * passes if n_all else 0):
        shared = spark.sparkContext.broadcast((model, moments))
        own = tasks.filter(F.pmod(F.col("block") + F.shiftright("block", 24), F.lit(ROUNDS)) == turn % ROUNDS)
        rows = own.mapInArrow(_learn(shared, turn, ROUNDS * passes), "bucket int, part int, n long, steps long, values binary")
        got = by_bucket(rows, _average, "bucket int, n long, steps long, values binary").collect()
        shared.unpersist()
        if not got:
            continue
        got.sort(key=lambda r: r.bucket)
        learned += got[0].n
        flat, at = np.frombuffer(b"".join(bytes(r["values"]) for r in got), np.float32), 0
        for d in (model.par, moments["first"], moments["second"]):
            for k, v in d.items():
                d[k] = flat[at : at + v.size].reshape(v.shape).copy()
                at += v.size
        moments["t"] = got[0].steps
    return learned


def log_likelihood(par: dict, ids: np.ndarray, bounds: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Natural log-probability of each document."""
    docs, hidden = len(bounds) - 1, len(par["u"])
    y, x, fresh, doc = _lay_out(ids, bounds, lanes, len(par["x"]) - 1)
    running = (doc >= 0).sum(1)
    out = np.zeros(docs)
    h, u = np.zeros((hidden, y.shape[1]), par["u"].dtype), np.ascontiguousarray(par["u"].T)
    for lo in range(0, len(y), WINDOW):
        outs, hi = [], min(lo + WINDOW, len(y))
        gates, anew = _gates(par, x[lo:hi, : running[lo]]), fresh[lo:hi].any(1)
        for s in range(hi - lo):
            m = running[lo + s]
            h = h[:, :m]
            if anew[s]:
                h = h * ~fresh[lo + s, :m]
            h, _ = _step(u, h, gates[s, :, :m])
            outs.append(h.T)
        here = doc[lo:hi] >= 0
        out += np.bincount(doc[lo:hi][here], _output(par, np.concatenate(outs), y[lo:hi][here]), docs)
    return out


def _corpus_counts(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """A group's words in order and their counts in the corpus."""
    u = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint64)
    c = [np.frombuffer(r["counts"], "<u4" if 2 * len(r["counts"]) == len(r["hashes"]) else "<u8").astype(float) for r in rows]
    order = np.argsort(u)
    return u[order], np.concatenate(c)[order]


def _score(side: str, shared, n_all: int, v_all: int):
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def finish(model: Model, pool: list) -> pa.RecordBatch:
        ids = np.concatenate([p[1] for p in pool])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in pool]))])
        score = log_likelihood(model.par, ids, bounds) / np.log(10) + np.concatenate([p[5] for p in pool])
        docs = [i for p in pool for i in p[0]]
        n = len(docs)
        cols = [docs, [is_held_out(i) for i in docs], np.diff(bounds), np.concatenate([p[3] for p in pool]), np.full(n, n_all), np.concatenate([p[4] for p in pool]), score]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts, pool, held = shared.value, SideReader(side), [], 0
        for group, blocks in each_group(batches):
            known, total = _corpus_counts(counts.get(group))
            for _, docs, texts in blocks:
                h, bounds = _tokens(texts)
                u, inverse = np.unique(h, return_inverse=True)
                c = total[np.searchsorted(known, u)]
                ids = model.encode(u)
                row = np.repeat(np.arange(len(docs)), np.diff(bounds))
                base = np.log10((c + 1) / (n_all + v_all + 1))
                rest = np.where(ids == model.other, np.log10((c + 1) / (model.rest_n + model.rest_v + 1)), 0.0)
                per_doc = [np.bincount(row, w[inverse], len(docs)) for w in ((c > 0).astype(float), base, rest)]
                pool.append((docs, ids[inverse], bounds, per_doc[0].astype(np.int64), per_doc[1], per_doc[2]))
                held += len(h)
                if held >= POOL_TOKENS:
                    yield finish(model, pool)
                    pool, held = [], 0
        if pool:
            yield finish(model, pool)

    return run


def score_documents(docs: DataFrame, hidden: int = HIDDEN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Learns from the rows whose crc32 of doc_id (as text) mod 7 is not 2; a null
    doc_id is learned from. Words are runs of characters other than the space
    and the controls 9 to 13, ASCII case folded, and each text ends in one end
    token, the only one of a null or empty text. Repeated rows count and are
    scored each for itself; an empty table gives no rows; without training
    words every word is unknown; other columns are not looked at.
    """
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    blocks = make_blocks(docs)
    sent = blocks.mapInArrow(_send_counts(buckets), "bucket int, block long, hashes binary, counts binary")
    counted = stash(by_bucket(sent, _sum_counts, "block long, bucket int, counts binary, hashes binary, n long, v long"), "counts")
    totals = counted.filter("block = -1")
    n_all, v_all = (x or 0 for x in totals.agg(F.sum("n"), F.sum("v")).first())
    top = totals.mapInArrow(_unpack_top, "hash long, c long").filter(F.col("hash") != int(END.astype(np.int64)))
    top = top.orderBy(F.desc("c"), "hash").limit(VOCABULARY).collect()
    hashes = np.array([r.hash for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], order.astype(np.int32), new_parameters(len(hashes) + 2, hidden), 0, 0)
    known = sum(r.c for r in top)
    end_count = _end_count(totals)
    model.rest_n, model.rest_v = int(n_all - known - end_count), max(0, int(v_all - len(top) - (end_count > 0)))
    c = np.ones(len(model.par["bc"]) * CLASS_WORDS)
    c[: len(hashes)] += [r.c for r in top]
    c[model.other] += model.rest_n
    c[model.other + 1] += end_count
    c = c.reshape(-1, CLASS_WORDS)
    model.par["bc"][:] = np.log(c.sum(1) / c.sum())  # start from the corpus counts
    model.par["bw"][:] = np.log(c / c.sum(1, keepdims=True))
    fit_rounds(blocks, model, int(n_all))
    side = write_side(counted.filter("block >= 0").select("block", "hashes", "counts"), "counts")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.mapInArrow(_score(side, spark.sparkContext.broadcast(model), n_all, v_all), schema)


def _end_count(totals: DataFrame) -> int:
    row = totals.mapInArrow(_unpack_top, "hash long, c long").filter(F.col("hash") == int(END.astype(np.int64))).agg(F.sum("c")).first()
    return int(row[0] or 0)
