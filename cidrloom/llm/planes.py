"""Operator 3: token ids in a bit- or byte-plane shuffled binary format.

A shard file holds ids in chunks of a fixed number of ids. A chunk is
transposed into planes (bit i of every id, or byte i of every id), and each
plane is compressed with zstandard by itself. Layout, little-endian::

    magic "CLP1"
    planes, one after the other
    document table, a block after every TABLE_ROWS documents, between the planes: zstandard of
        int64 doc ids, then of uint64 counts, then of null marks
    footer: JSON with the chunk index (offset, ids, size of each plane) and the table's blocks
    uint64 length of the footer, magic "CLP1"

Scale: documents are range-partitioned by id once, and each task encodes and
writes its shard in one stream with memory for one chunk. What comes back to
the driver is one row a shard, whose running sum gives each shard's start.
A task writes under a name of its own attempt, and only names that a finished
task returned are in the manifest, so lost or repeated tasks leave no trace.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textwords import split_words, text_column
from .workspace import bounded_batches, filesystem, new_folder, partitions

MAGIC = b"CLP1"
CHUNK = 1 << 16
END_ID = 0
#: Pieces that the library encodes at once.
PIECES = 2048
#: Documents in a block of a file's document table.
TABLE_ROWS = 1 << 16


class PlaneWriter:
    """Appends documents' ids to a shard file."""

    def __init__(self, sink, mode: str = "byte", chunk: int = CHUNK, level: int = 3):
        if mode not in ("byte", "bit"):
            raise ValueError(f"planes are bit or byte, not {mode}")
        self.sink, self.mode, self.chunk = sink, mode, chunk
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self.chunks: list[tuple[int, int, list[int]]] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.n_docs = 0
        self.table: list[list[int]] = []
        self.at = sink.write(MAGIC) or len(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.n_docs += 1
        if len(self.docs) == TABLE_ROWS:
            self._write_table()
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.chunk:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        cut = len(ids) if rest else len(ids) // self.chunk * self.chunk
        for lo in range(0, cut, self.chunk):
            self._write(np.ascontiguousarray(ids[lo : min(cut, lo + self.chunk)], "<u4"))
        self.held, self.n_held = [ids[cut:].copy()], len(ids) - cut

    def _write(self, ids: np.ndarray) -> None:
        octets = ids.view(np.uint8).reshape(-1, 4)
        planes = octets.T if self.mode == "byte" else np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1)
        sizes = []
        for p in planes:
            z = self.zip.compress(np.ascontiguousarray(p).tobytes())
            self.sink.write(z)
            sizes.append(len(z))
        self.chunks.append((self.at, len(ids), sizes))
        self.at += sum(sizes)

    def _write_table(self) -> None:
        null = np.array([d is None for d in self.docs], np.uint8)
        parts = [self.zip.compress(a.tobytes()) for a in (np.array([d or 0 for d in self.docs], "<i8"), np.array(self.counts, "<u8"), null)]
        self.sink.write(b"".join(parts))
        self.table.append([self.at, len(self.docs), *map(len, parts)])
        self.at += sum(map(len, parts))
        self.docs, self.counts = [], []

    def close(self) -> None:
        self._flush(True)
        self._write_table()
        foot = json.dumps({"mode": self.mode, "chunks": self.chunks, "table": self.table}).encode()
        self.sink.write(foot + struct.pack("<Q", len(foot)) + MAGIC)


class PlaneReader:
    """Reads a shard file; any chunk can be read without the others."""

    def __init__(self, source, size: int):
        self.source = source
        tail = self._at(size - 12, 12)
        if tail[8:] != MAGIC or self._at(0, 4) != MAGIC:
            raise ValueError("not a plane file")
        n = struct.unpack("<Q", tail[:8])[0]
        foot = json.loads(self._at(size - 12 - n, n))
        self.mode, self.chunks, self.table = foot["mode"], foot["chunks"], foot["table"]

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def chunk(self, i: int) -> np.ndarray:
        offset, n, sizes = self.chunks[i]
        raw, at, planes = self._at(offset, sum(sizes)), 0, []
        for s in sizes:
            planes.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[at : at + s]), np.uint8))
            at += s
        if self.mode == "byte":
            octets = np.ascontiguousarray(np.stack(planes, 1))
        else:
            bits = np.unpackbits(np.stack(planes), axis=1, count=n)
            octets = np.packbits(bits.T, axis=1, bitorder="little")
        return np.ascontiguousarray(octets).view("<u4").reshape(-1)

    def _rows(self) -> Iterator[tuple[int | None, int]]:
        for at, _, *sizes in self.table:
            parts = []
            for s in sizes:
                parts.append(zstandard.ZstdDecompressor().decompress(self._at(at, s)))
                at += s
            for d, c, missing in zip(*(np.frombuffer(x, t).tolist() for x, t in zip(parts, ("<i8", "<u8", "<u1")))):
                yield (None if missing else d), c

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, n_held, nxt = [], 0, 0
        for d, c in self._rows():
            while n_held < c:
                held.append(self.chunk(nxt))
                n_held += len(held[-1])
                nxt += 1
            if len(held) > 1:
                held = [np.concatenate(held)]
            yield d, held[0][:c] if held else np.zeros(0, "<u4")
            if held:
                held, n_held = [held[0][c:]], n_held - c


#: White space other than single spaces and newlines between other characters.
_ODD = re.compile(r"\A\s|\s\Z|\s\s|[^\S \n]|[\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: Bytes of which white space other than spaces and newlines always holds one; and spaces and newlines.
_RARE, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_RARE[[0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_BLANK[[0x20, 0x0A]] = True
_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_TAIL = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_SPACED, _BARE = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def _odd_rows(col: pa.Array, data: np.ndarray) -> np.ndarray:
    """Which texts of a column of large strings have odd white space; ``data`` are their bytes."""
    at = np.concatenate([[0], np.cumsum(pc.binary_length(col).to_numpy())])
    blank, mark = _BLANK[data], _RARE[data]
    mark[:-1] |= blank[:-1] & blank[1:]
    some = np.flatnonzero(np.diff(at))
    mark[at[some]] |= blank[at[some]]
    mark[at[some + 1] - 1] |= blank[at[some + 1] - 1]
    odd = np.zeros(len(col), bool)
    for i in np.unique(np.searchsorted(at, np.flatnonzero(mark), "right") - 1).tolist():
        odd[i] = bool(_ODD.search(col[i].as_py()))
    return odd


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, or a copy with half as much room again, if it has fewer than ``n`` entries."""
    if len(a) >= n:
        return a
    out = np.empty(max(n, len(a) * 3 // 2), a.dtype)
    out[: len(a)] = a
    return out


class PieceTable:
    """Open-addressing table from 64-bit hashes of pieces to their ids, all in arrays."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.n = self.used = 0
        self.offset, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, "<u4")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        todo, slot = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            k = self.keys[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.at[slot[hit]]
            go = ~hit & (k != 0)
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Insert distinct new hashes; ``flat`` has the ids of all, ``size`` how many each has."""
        self.offset, self.length = _grown(self.offset, self.n + len(h)), _grown(self.length, self.n + len(h))
        self.ids = _grown(self.ids, self.used + len(flat))
        new = np.arange(self.n, self.n + len(h))
        self.ids[self.used : self.used + len(flat)] = flat
        self.offset[new], self.length[new] = self.used + np.cumsum(size) - size, size
        self.n, self.used = self.n + len(h), self.used + len(flat)
        todo, slot = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            mine = self.keys[slot] == h[todo]
            self.at[slot[mine]] = new[todo[mine]]
            todo, slot = todo[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def ids_of(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries, one after the other, and how many each has."""
        n = self.length[entry]
        ends = np.cumsum(n)
        at = np.repeat(self.offset[entry] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[at], n


class Encoder:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library.

    Its pattern always starts a new piece at a single space or newline between
    other characters, and between a letter or digit and the punctuation that
    ends a word. Texts are cut there, and every different piece is encoded by
    the library once and remembered under its 64-bit hash; the table starts
    anew when half full. New pieces go to the library many in one text, a
    newline between any two. Texts with other white space go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.table = PieceTable()
        newline = self._library("\n")
        self.newline = newline[0] if len(newline) == 1 else None

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without newlines, one after the other, and how many each has.

        A few at a time: the library's own results take many times the ids'
        memory. One by one, if newlines don't come back as one id each.
        """
        flat, size = [np.zeros(0, "<u4")], [np.zeros(0, np.int32)]
        for lo in range(0, len(pieces), PIECES):
            some = pieces[lo : lo + PIECES]
            ids = self._library("\n".join(some))
            ends = np.flatnonzero(ids == self.newline) if self.newline is not None else np.zeros(0, np.int64)
            if len(ends) == len(some) - 1:
                flat.append(np.delete(ids, ends))
                size.append(np.diff(np.concatenate([[-1], ends, [len(ids)]])).astype(np.int32) - 1)
            else:
                each = [self._library(x) for x in some]
                flat.extend(each)
                size.append(np.array([len(x) for x in each], np.int32))
        return np.concatenate(flat), np.concatenate(size)

    def _learn(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, spaced: np.ndarray, raw: bytes) -> np.ndarray:
        """Entries of all pieces, after the library has encoded those that are new."""
        found = self.table.find(h)
        new = np.flatnonzero(found < 0)
        if not len(new):
            return found
        new = new[np.unique(h[new], return_index=True)[1]]
        if self.table.n + len(new) > 1 << (self.table.bits - 1):
            new = np.unique(h, return_index=True)[1]
            while len(new) > 1 << (self.table.bits - 1):  # one text of very many pieces
                self.table.bits += 1
            self.table.clear()
        pieces = [raw[a:b].decode() for a, b in zip((start[new] - spaced[new]).tolist(), end[new].tolist())]
        if "\n" in pieces:
            at = pieces.index("\n")
            ids = self._library(pieces.pop(at))
            self.table.add(h[new[at : at + 1]], ids, np.array([len(ids)], np.int32))
            new = np.delete(new, at)
        self.table.add(h[new], *self._pieces(pieces))
        return self.table.find(h)

    def encode_column(self, col: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column of large strings, and the end id."""
        end_id = np.array([END_ID], "<u4")
        for words in split_words(col, False, max_bytes=1 << 19):
            texts = col.slice(words.lo, words.hi - words.lo)
            odd = _odd_rows(texts, words.data)
            row = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
            plain = ~odd[row]
            data, start, end, row = words.data, words.start[plain], words.end[plain], row[plain]
            first = np.ones(len(row), bool)
            first[1:] = row[1:] != row[:-1]
            before = data[np.maximum(start - 1, 0)]
            spaced, newline = ~first & (before == 0x20), ~first & (before == 0x0A)
            stop = end.copy()  # where the word's body ends and its punctuation starts
            going = np.arange(len(start))
            while len(going):
                going = going[(stop[going] > start[going]) & _TAIL[data[stop[going] - 1]]]
                stop[going] -= 1
            last = data[np.maximum(stop - 1, 0)]
            latin = (data[np.maximum(stop - 2, 0)] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (stop - start >= 2)
            stop = np.where((stop > start) & (_ALNUM[last] | latin), stop, end)
            tail = stop < end
            h = words.hashes(start, stop) ^ np.where(spaced, _SPACED, _BARE)
            ht = words.hashes(stop, end) ^ _BARE
            hn = words.hashes(np.maximum(start - 1, 0), start) ^ _BARE
            every = np.concatenate([h, ht[tail], hn[newline]])
            spans = [np.concatenate(x) for x in ((start, stop[tail], start[newline] - 1), (stop, end[tail], start[newline]), (spaced, np.zeros(int(tail.sum() + newline.sum()), bool)))]
            found = self._learn(every, *spans, data.tobytes())
            entry = np.full((len(start), 3), -1, np.int32)
            entry[:, 1] = found[: len(h)]
            entry[tail, 2] = found[len(h) : len(h) + int(tail.sum())]
            entry[newline, 0] = found[len(h) + int(tail.sum()) :]
            here = entry >= 0
            ids, n = self.table.ids_of(entry[here])
            each = np.bincount(np.repeat(row, 3)[here.ravel()], n, len(texts)).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(each)])
            for i in range(len(texts)):
                mine = self._library(texts[i].as_py()) if odd[i] else ids[at[i] : at[i + 1]]
                yield np.concatenate([mine, end_id])

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_column(pa.array([text], pa.large_string())))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write_shards(uri: str, tokenizer: str, mode: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(uri)
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.clp"
        with fs.open_output_stream(f"{folder}/{name}") as sink:
            out = PlaneWriter(sink, mode, chunk)
            for b in batches:
                for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode_column(text_column(b))):
                    out.add(d, ids)
            out.close()
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "name": name, "n_docs": out.n_docs, "n_ids": out.total}],
            pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    return run


def write_ids(docs: DataFrame, uri: str, tokenizer: str, mode: str = "byte", chunk: int = CHUNK, ordered: bool = True) -> list[dict]:
    """Encode ``docs`` (doc_id, text) into shards in ascending doc_id order; returns the manifest.

    If not ``ordered``, shards and documents stay in the order in which the
    table is read, which keeps a shuffled table shuffled. Null ids come first; rows of equal ids are in order of their texts. A null
    text is an empty one, and every document ends with id 0, so an empty one
    has that id alone. An empty table gives shards without documents. Other
    columns are not looked at. The manifest (shard, name, n_docs, n_ids, start)
    is also written to ``manifest.json``.
    """
    bounded_batches(docs.sparkSession)
    fs, folder = filesystem(uri)
    fs.create_dir(folder, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if ordered:
        # by a text's start as well, so that rows of one id may be split
        rows = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    rows = (
        rows.mapInArrow(_write_shards(uri, tokenizer, mode, chunk), "shard int, name string, n_docs long, n_ids long")
        .collect()  # one row a shard
    )
    manifest, start = [], 0
    for r in sorted(rows, key=lambda r: r.shard):
        manifest.append(r.asDict() | {"start": start})
        start += r.n_ids
    with fs.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _read_shards(uri: str):
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(uri)
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist()):
                path, out = f"{folder}/{name}", []
                with fs.open_input_file(path) as f:
                    for d, ids in PlaneReader(f, f.size()).documents():
                        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [k for k, _ in fields])
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [k for k, _ in fields])

    return run


def read_ids(spark, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards' files.

    One row for each row that was written, with its id, null or repeated; files
    without documents give none.
    """
    fs, folder = filesystem(uri)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.read())
    index = spark.createDataFrame([(m["shard"], m["name"], m["start"]) for m in manifest], "shard int, name string, start long")
    index = index.repartitionByRange(max(1, len(manifest)), "shard")
    return index.mapInArrow(_read_shards(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, mode: str = "byte", ordered: bool = True) -> DataFrame:
    """Write ``docs`` as token ids to the shared folder and return what its files hold.

    Null and empty texts, null and repeated ids and empty tables: see ``write_ids``.
    """
    spark = docs.sparkSession
    uri = new_folder(spark, "ids")
    write_ids(docs, uri, tokenizer, mode, ordered=ordered)
    return read_ids(spark, uri)


def to_bytes(documents: list[tuple[int | None, np.ndarray]], mode: str = "byte", chunk: int = CHUNK) -> bytes:
    """A shard file in memory."""
    sink = io.BytesIO()
    out = PlaneWriter(sink, mode, chunk)
    for d, ids in documents:
        out.add(d, ids)
    out.close()
    return sink.getvalue()
