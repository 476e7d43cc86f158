"""Vectorized word splitting and 64-bit word hashes over Arrow string columns.

Words are runs of bytes that are not delimiters. All delimiters are ASCII, so
splitting UTF-8 bytes equals splitting characters. A hash is a polynomial over
the word's bytes modulo 2**64 with a final mix: no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M = 0x9E3779B97F4A7C15 | 1
_MINV = pow(_M, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither a letter nor a digit.
PUNCT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or len(_tables["p"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("p", _M), ("i", _MINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _tables[key] = np.multiply.accumulate(a)
    return _tables["p"], _tables["i"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of consecutive rows ``lo:hi`` of a batch."""

    lo: int
    hi: int
    data: np.ndarray  # bytes of the texts, one after the other
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    bounds: np.ndarray  # bounds[i]:bounds[i + 1] are the words of row lo + i
    _sums: np.ndarray | None = None

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word, or of other byte spans."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        p, inv = _powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            v = self.data.astype(np.uint64)
            v += np.uint64(1)
            v *= p[: len(v)]
            np.cumsum(v, out=self._sums[1:])
        return mix64((self._sums[end] - self._sums[start]) * inv[start])


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as large strings without nulls (null: empty)."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def split_words(col: pa.Array, lower: bool, delimiters: np.ndarray = SPACE, max_bytes: int = 1 << 20) -> Iterator[Words]:
    """Words of all rows, in blocks of about ``max_bytes`` (a longer text is a block of its own)."""
    n = len(col)
    if not n:
        return
    _, raw_off, raw = col.buffers()
    off = np.frombuffer(raw_off, np.int64)[col.offset : col.offset + n + 1]
    everything = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        data = everything[off[lo] : off[hi]]
        if lower:
            data = LOWER[data]
        at = off[lo : hi + 1] - off[lo]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~delimiters[data]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        first[edge] |= inside[edge + 1]
        last[edge - 1] |= inside[edge]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        yield Words(lo, hi, data, start, end, np.searchsorted(start, at))
        lo = hi


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; entry i covers words i to i + k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += h[j : j + n]
    return mix64(out)
