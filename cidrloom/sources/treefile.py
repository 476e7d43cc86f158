"""The binary search-tree file: writing layers and reading them as a data source."""

from __future__ import annotations

import mmap
import os
import pickle
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import wire
from ..functions.addr import shown
from ..functions.space import IPV4_DEPTH, V4, V6, wide
from ..operators.interpret import ALIAS, DATA, Layer
from ..plans.tables import settle, shared_dir

SEPARATOR = bytes(16)
#: Three marker bytes and the name that readers of this format search for.
MARKER = bytes.fromhex("abcdef4d61784d696e642e636f6d")
MAX_METADATA = 128 * 1024


@dataclass
class Options:
    """Metadata of a file."""

    build_epoch: int | None = None
    database_type: str = ""
    description: dict[str, str] = field(default_factory=dict)
    languages: list[str] = field(default_factory=list)
    ip_version: int = 6
    record_size: int = 28
    metadata_pointers: bool = True

    def __post_init__(self) -> None:
        if self.ip_version not in (4, 6):
            raise ValueError(f"unsupported IPVersion: {self.ip_version}")
        if self.record_size not in (24, 28, 32):
            raise ValueError(f"unsupported RecordSize: {self.record_size}")
        if self.build_epoch is None:
            self.build_epoch = int(time.time())
        if self.build_epoch < 0:
            raise ValueError(f"BuildEpoch must not be negative: {self.build_epoch}")


def pack_node(left: int, right: int, size: int) -> bytes:
    """Two record values in 6, 7 or 8 bytes."""
    if max(left, right) >= 1 << size:
        raise ValueError(f"record values {left} and {right} need more than {size} bits; a larger record size or a smaller layer is needed")
    if size == 28:
        high = (left >> 24) << 4 | right >> 24
        return (left & 0xFFFFFF).to_bytes(3, "big") + bytes([high]) + (right & 0xFFFFFF).to_bytes(3, "big")
    return left.to_bytes(size // 8, "big") + right.to_bytes(size // 8, "big")


def unpack_node(data: bytes, at: int, size: int) -> tuple[int, int]:
    raw = data[at : at + size // 4]
    if size == 28:
        return (raw[3] >> 4) << 24 | int.from_bytes(raw[:3], "big"), (raw[3] & 15) << 24 | int.from_bytes(raw[4:], "big")
    half = size // 8
    return int.from_bytes(raw[:half], "big"), int.from_bytes(raw[half:], "big")


def metadata_bytes(options: Options, node_count: int) -> bytes:
    if node_count >= 1 << 32:
        raise ValueError(f"node count of {node_count} exceeds the maximum allowed value")
    fields = {
        "binary_format_major_version": ("uint16", 2),
        "binary_format_minor_version": ("uint16", 0),
        "build_epoch": ("uint64", options.build_epoch),
        "database_type": ("string", options.database_type),
        "description": ("map", {k: ("string", v) for k, v in options.description.items()}),
        "ip_version": ("uint16", options.ip_version),
        "languages": ("slice", [("string", x) for x in options.languages]),
        "node_count": ("uint32", node_count),
        "record_size": ("uint16", options.record_size),
    }
    section = wire.DataSection(options.metadata_pointers)
    section.place(("map", fields))
    return bytes(section.out)


def layer_bytes(layer: Layer, options: Options) -> bytes:
    """The file of a layer held in memory."""
    keys = layer.node_keys()
    number = {k: i for i, k in enumerate(keys)}
    data, out = wire.DataSection(), bytearray()
    for a, d in keys:
        pair = []
        for side in (0, 1):
            at = a + side * (1 << (layer.bits - d - 1))
            if (at, d + 1) in number:
                pair.append(number[at, d + 1])
                continue
            r = layer.rec[at]
            if r.kind == DATA:
                pair.append(len(keys) + len(SEPARATOR) + data.place(r.value))
            else:
                pair.append(number[0, 96] if r.kind == ALIAS else len(keys))
        out += pack_node(*pair, options.record_size)
    return bytes(out) + SEPARATOR + bytes(data.out) + MARKER + metadata_bytes(options, len(keys))


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def _pack_nodes(folder: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _filesystem(folder)
        name, first = f"{at}/nodes-{uuid.uuid4().hex}", None
        with fs.open_output_stream(name) as out:
            for b in batches:
                for node, left, right in zip(*(b.column(c).to_pylist() for c in ("node", "s0", "s1"))):
                    first = node if first is None else first
                    out.write(pack_node(left, right, size))
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], ["first", "name"])

    return run


def write_records(records: DataFrame, path: str, options: Options, reserved: bool = False, aliases: bool = False) -> int:
    """Write disjoint records as one file, at a path or URI that pyarrow knows; returns its size.

    Records are (lo, plen) of either space, IPv4 ones going to ``::/96`` of a
    tree of both families, and ``wire`` (encoded values) or ``value`` (JSON).
    With ``reserved`` and ``aliases`` the tree holds those networks as well.

    Nodes, their numbers and their children are found by joins, and tasks pack
    the nodes into files of the shared folder, which the driver puts one behind
    the other as a stream. Only the distinct values, in the order of their first
    use, go through one place at a time, as the format's back references require.
    """
    from ..operators.audit import numbered_nodes
    from ..operators.special import tree_cover

    spark = records.sparkSession
    space = V4 if options.ip_version == 4 else V6
    narrow = not isinstance(records.schema["lo"].dataType, StructType)
    if space is V4 and not narrow:
        raise ValueError("IPv6 records need a file of ip_version 6")
    value = "wire" if "wire" in records.columns else "value"
    lo, plen = F.col("lo"), F.col("plen")
    if space is V6 and narrow:
        lo, plen = wide(F.lit(0).cast("long"), lo), plen + IPV4_DEPTH
    rows = records.select(lo.alias("lo"), plen.alias("plen"), F.col(value).alias("value"))
    ranges = rows.select("lo", space.end(F.col("lo"), F.col("plen")).alias("hi"), "value")
    cover = settle(tree_cover(ranges, ["value"], space, reserved, aliases).withColumnRenamed("plen", "depth"), "cover")
    nodes = settle(numbered_nodes(cover.select("lo", F.col("depth").alias("plen")), space), "nodes")
    n = nodes.count()
    if n >= 1 << 32:
        raise ValueError(f"node count of {n} exceeds the maximum allowed value")
    below = F.col("depth") + 1
    right = space.end(F.col("lo"), below)
    sides = nodes.select("node", below.alias("depth"), F.posexplode(F.array("lo", right)).alias("side", "lo"))
    child = sides.join(nodes.withColumnRenamed("node", "child"), ["lo", "depth"], "left").join(cover, ["lo", "depth"], "left")
    child = settle(child.select("node", "side", "child", "kind", "value"), "children")
    section, folder = wire.DataSection(), f"{shared_dir(spark)}/cidrloom-tree-{uuid.uuid4().hex}"
    fs, at = _filesystem(folder)
    fs.create_dir(at, recursive=True)
    first = child.filter("value is not null").groupBy("value").agg(F.min(F.col("node") * 2 + F.col("side")).alias("use")).orderBy("use")
    # sizes are bounded by the format: an offset has 32 bits
    kind = pa.schema([("value", pa.binary() if value == "wire" else pa.string()), ("place", pa.int64())])
    with pq.ParquetWriter(f"{at}/places.parquet", kind, filesystem=fs) as places:
        held: list[tuple] = []
        for r in first.toLocalIterator():
            v = r["value"]
            held.append((v, section.place(wire.decode(bytes(v), 0)[0] if value == "wire" else wire.from_text(v))))
            if len(held) == 1 << 16:
                places.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kind.types)], schema=kind))
                held = []
        if held:
            places.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kind.types)], schema=kind))
    root4 = nodes.filter((F.col("lo") == space.literal(0)) & (F.col("depth") == IPV4_DEPTH)).select("node").first() if aliases and space is V6 else None
    placed = child.join(spark.read.parquet(f"{folder}/places.parquet"), "value", "left")
    number = F.coalesce("child", F.when(F.col("kind") == "alias", F.lit(root4.node if root4 else n)), F.col("place") + n + len(SEPARATOR), F.lit(n)).cast("long")
    pairs = placed.groupBy("node").agg(*[F.max(F.when(F.col("side") == i, number)).alias(f"s{i}") for i in (0, 1)])
    parts = pairs.repartitionByRange("node").sortWithinPartitions("node").mapInArrow(_pack_nodes(folder, options.record_size), "first long, name string")
    total = 0
    target, name = _filesystem(path)
    with target.open_output_stream(name) as out:
        for r in sorted(parts.collect(), key=lambda r: r["first"]):  # one row a task
            with fs.open_input_stream(r["name"]) as part:
                while piece := part.read(1 << 24):
                    out.write(piece)
                    total += len(piece)
        for piece in (SEPARATOR, bytes(section.out), MARKER, metadata_bytes(options, n)):
            out.write(piece)
            total += len(piece)
    fs.delete_dir(at)
    return total


class TreeFile:
    """A file in memory."""

    def __init__(self, data: bytes):
        self.data = data
        at = data.rfind(MARKER, max(0, len(data) - MAX_METADATA))
        if at < 0:
            raise wire.WireError("no metadata: this is not a search-tree file")
        at += len(MARKER)
        meta = wire.decode(data[at:], 0)[0]
        self.meta = wire.to_plain(meta)
        for name in ("node_count", "record_size", "ip_version"):
            x = self.meta.get(name)
            if not isinstance(x, int) or not 0 < x < 1 << (32 if name == "node_count" else 31):
                raise wire.WireError(f"unsupported {name} in metadata: {x}")
        if self.meta["ip_version"] not in (4, 6):
            raise wire.WireError(f"unsupported ip_version in metadata: {self.meta['ip_version']}")
        if self.meta["record_size"] not in (24, 28, 32):
            raise wire.WireError(f"unsupported record_size in metadata: {self.meta['record_size']}")
        self.nodes, self.size = self.meta["node_count"], self.meta["record_size"]
        self.bits = 32 if self.meta["ip_version"] == 4 else 128
        self.base = self.nodes * self.size // 4 + len(SEPARATOR)
        self.memo: dict[int, wire.Value] = {}

    def ipv4_root(self) -> int:
        """Node of ``::/96`` in a tree of both families."""
        node = 0
        for _ in range(96 if self.bits == 128 else 0):
            if node >= self.nodes:
                break
            node = unpack_node(self.data, node * self.size // 4, self.size)[0]
        return node

    def children(self, node: int) -> tuple[int, int]:
        return unpack_node(self.data, node * self.size // 4, self.size)

    def parts(self, most: int) -> list[tuple[int, int, int, int]]:
        """(weight, node, address, depth) of subtrees in address order that together are the tree.

        Numbers are in preorder, so a left subtree's weight is the distance to its sibling.
        """
        todo, done = [(self.nodes, 0, 0, 0)], []
        while todo and len(todo) + len(done) < most:
            todo.sort()
            weight, node, a, d = todo.pop()
            if node >= self.nodes or weight <= 1 or d >= self.bits:
                done.append((weight, node, a, d))
                continue
            left, right = self.children(node)
            mine = right - left if left < right < node + weight else weight - 1
            mine = mine if left > node else 1  # an alias leads back
            todo.append((max(1, mine), left, a, d + 1))
            todo.append((max(1, weight - 1 - mine), right, a | 1 << (self.bits - d - 1), d + 1))
        return sorted(done + todo, key=lambda p: p[2:])

    def walk(self, aliased: bool = False, start: tuple[int, int, int] = (0, 0, 0)) -> Iterator[tuple[int, int, wire.Value]]:
        """(address, depth, value) in order, from a node, its address and depth."""
        root4 = self.ipv4_root()
        todo = [start]
        while todo:
            node, a, d = todo.pop()
            if d > self.bits:
                raise wire.WireError("the search tree is deeper than its addresses")
            if node == self.nodes:
                continue
            if node > self.nodes:
                at = node - self.nodes - len(SEPARATOR)
                if at not in self.memo:
                    self.memo[at] = wire.decode(self.data, self.base + at, self.base, self.memo)[0]
                yield a, d, self.memo[at]
                continue
            if self.bits == 128 and not aliased and node == root4 and root4 < self.nodes and a != 0 and d > 0:
                continue
            if d == self.bits:
                raise wire.WireError("the search tree is deeper than its addresses")
            left, right = self.children(node)
            todo.append((right, a | 1 << (self.bits - d - 1), d + 1))
            todo.append((left, a, d + 1))


def load_layer(path: str, reserved: bool = True, aliases: bool = True, fn=None) -> tuple[Layer, Options]:
    """A file as a layer, and the options it carries (not its build epoch)."""
    from ..operators.interpret import replace

    with open(path, "rb") as f:
        tree = TreeFile(f.read())
    m = tree.meta
    layer = Layer(tree.bits, reserved, aliases)
    for a, d, value in tree.walk(aliased=not aliases):
        network = shown(layer._bytes(a), d, tree.bits)
        try:
            layer.insert(network, value, fn or replace)
        except ValueError as error:
            raise ValueError(f"loading network {network} from {path}: {error}") from error
    return layer, Options(database_type=m.get("database_type", ""), description=m.get("description", {}), languages=m.get("languages", []), ip_version=m["ip_version"], record_size=m["record_size"])


class _Part(InputPartition):
    def __init__(self, start: tuple[int, int, int]):
        self.start = start


class _Reader(DataSourceReader):
    """Tasks map the file and touch the pages of their subtree and its values only."""

    PARTS = 64

    def __init__(self, path: str, aliased: bool):
        self.path, self.aliased = path, aliased

    def _open(self) -> TreeFile:
        with open(self.path, "rb") as f:
            return TreeFile(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def partitions(self) -> list[InputPartition]:
        return [_Part(p[1:]) for p in self._open().parts(self.PARTS)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        tree = self._open()
        for a, d, value in tree.walk(self.aliased, partition.start):
            raw = a.to_bytes(tree.bits // 8, "big") + bytes(16 - tree.bits // 8)
            yield shown(raw, d, tree.bits), raw, d, wire.to_text(value), wire.encode(value)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    """Tasks write their rows aside; the commit inserts them, shortest networks first, and writes the file.

    For layers that fit the driver; ``write_records`` has no such limit.
    """

    def __init__(self, path: str, names: list[str], options: dict[str, str]):
        self.path, self.names, self.options = path, names, options

    def write(self, iterator: Iterator) -> _Written:
        name = f"{self.path}.{uuid.uuid4().hex}.part"
        with open(name, "wb") as f:
            pickle.dump([tuple(r[c] for c in self.names) for r in iterator], f)
        return _Written(name)

    def commit(self, messages: list) -> None:
        rows: list[tuple] = []
        for m in messages:
            with open(m.name, "rb") as f:
                rows += pickle.load(f)
        get = lambda k, d: self.options.get(k, d)
        options = Options(int(get("build_epoch", "0")) or None, get("database_type", ""), ip_version=int(get("ip_version", "6")), record_size=int(get("record_size", "28")))
        layer = Layer(32 if options.ip_version == 4 else 128, get("reserved", "true") == "true", get("aliases", "true") == "true")
        for network, value in sorted(rows, key=lambda r: int(r[0].rpartition("/")[2])):
            layer.insert(network, wire.decode(bytes(value), 0)[0] if isinstance(value, (bytes, bytearray)) else wire.from_text(value))
        temp = f"{self.path}.{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            f.write(layer_bytes(layer, options))
        os.replace(temp, self.path)
        self._clear(messages)

    def abort(self, messages: list) -> None:
        self._clear(messages)

    def _clear(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.name):
                os.remove(m.name)


class TreeFileSource(DataSource):
    """Format ``prefix_tree``.

    Reading a path gives (network, addr, depth, value as JSON, wire: the encoded
    value). Writing takes (network, wire) or (network, value) rows and the
    options build_epoch, database_type, ip_version, record_size, reserved and
    aliases. The path is one that the driver and the executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "prefix_tree"

    def schema(self) -> str:
        return "network string, addr binary, depth int, value string, wire binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("include_aliased", "false") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"]
        if not overwrite and os.path.exists(path):
            raise ValueError(f"{path} is there already")
        return _Writer(path, ["network", "wire" if "wire" in schema.names else "value"], dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeFileSource)


def read_tree(spark: SparkSession, path: str, include_aliased: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("prefix_tree").option("include_aliased", str(include_aliased).lower()).load(path)


def roundtrip(records: DataFrame) -> DataFrame:
    """Write records to a file of the shared folder and read it back: (network, value)."""
    spark = records.sparkSession
    path = f"{shared_dir(spark)}/cidrloom-{uuid.uuid4().hex}.tree"
    write_records(records, path, Options(build_epoch=0, ip_version=4))
    return read_tree(spark, _filesystem(path)[1]).select("network", "value")
