"""HDF5 files as a Spark data source: read by chunks on executors, written by cells at their places in one file.

The layout is that of the public HDF5 file format specification. Reading: superblocks 0, 2 and 3; groups as symbol tables or as
links in the header; attributes in the header; contiguous, compact and chunked data (B-trees of version 1, single chunks, implicit and fixed
arrays), with the deflate, shuffle and checksum filters; integers and floating-point numbers of either byte order. A file is described by a task, never by the
driver. A scan's partitions are ranges of the grid of chunks, found by arithmetic; each task descends the chunk index to its own chunks, so
neither the index nor any data passes through the driver. Filters on coordinates leave out chunks that hold none of their cells.

Writing: float64 data of fixed place and length, so tasks write their cells into the one file wherever they belong, in any order and
as often as they are retried; the file takes its name when all cells are there. Paths are those of a file system that all executors mount (for reading,
any that pyarrow knows).
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from fieldweave.field import Field, coords

# Marks of the file format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
DATASPACE, LINK_INFO, DATATYPE, FILL_VALUE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOL_TABLE, ATTRIBUTE_INFO = 0x1, 0x2, 0x3, 0x5, 0x6, 0x8, 0xB, 0xC, 0x10, 0x11, 0x15
DEFLATE, SHUFFLE, FLETCHER32 = 1, 2, 3
NOWHERE = 0xFFFFFFFFFFFFFFFF

#: Names under which a file may hold its data, and its spacing, in the order they are looked for.
DATA_NAMES = ("field", "data")
SPACING_HINTS = ("spacing", "dx", "voxel_size", "resolution")
#: Bytes of a stretch of contiguous data that is read like a chunk.
STRETCH_BYTES = 8 << 20
#: Cells of a scan's partition, and the most partitions of a scan.
PARTITION_CELLS, MOST_PARTITIONS = 4 << 20, 100_000
#: Cells of an Arrow batch.
BATCH_CELLS = 1 << 17


class Hdf5Error(ValueError):
    """The file is no HDF5 file, or uses something that is not read here."""


class _Bytes:
    """Reads numbers from bytes in turn."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise Hdf5Error("a structure ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def numbers(self, count: int, n: int = 8) -> tuple[int, ...]:
        return tuple(self.number(n) for _ in range(count))

    def pad(self, start: int, to: int = 8) -> None:
        self.at = start + -(-(self.at - start) // to) * to


@dataclass(frozen=True)
class Dataset:
    """What a dataset's header says: where the data lies and how it is to be read."""

    shape: tuple[int, ...] = ()
    dtype: str | None = None
    kind: str = "none"
    address: int = NOWHERE
    size: int = 0
    chunk: tuple[int, ...] = ()
    #: chunk index: btree, single, implicit or fixed; and what else the layout says of it
    index: str = ""
    single: tuple[int, int] = (0, 0)
    filters: tuple[tuple[int, tuple[int, ...]], ...] = ()
    fill: bytes = b""
    inline: bytes = b""
    attributes: dict[str, list[float]] = field(default_factory=dict)

    @property
    def is_array(self) -> bool:
        return self.dtype is not None and len(self.shape) > 0 and self.kind != "none"


class Hdf5File:
    """The structures of a file, read where they are needed."""

    def __init__(self, path: str):
        from pyarrow import fs

        if "://" in path or path.startswith("file:"):
            store, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
        else:
            store, inner = fs.LocalFileSystem(), os.path.abspath(path)
        self.path, self.file, self.nodes = path, store.open_input_file(inner), {}
        self.length = self.file.size()
        at = 0
        while self._raw(at, 8) != SIGNATURE:
            at = at * 2 or 512
            if at >= self.length:
                raise Hdf5Error(f"{path} is no HDF5 file")
        self.base = at
        head = _Bytes(self._raw(at, min(128, self.length - at)), 8)
        version = head.number(1)
        if version in (0, 1):
            head.take(4)
            sizes = head.numbers(2, 1)
            head.take(1 + 4 + 4 + (4 if version else 0))
            self.base = head.number(8)
            head.take(8 * 3 + 8)
            self.root = head.number(8)
        elif version in (2, 3):
            sizes = head.numbers(2, 1)
            head.take(1)
            self.base = head.number(8)
            head.take(16)
            self.root = head.number(8)
        else:
            raise Hdf5Error(f"superblock of version {version}")
        if sizes != (8, 8):
            raise Hdf5Error(f"offsets and lengths of {sizes} bytes; 8 are read")

    def close(self) -> None:
        self.file.close()

    def _raw(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def read(self, at: int, n: int) -> bytes:
        out = self._raw(self.base + at, n)
        if len(out) < n:
            raise Hdf5Error(f"{self.path} ends before byte {self.base + at + n}")
        return out

    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        """Kind and content of every message of an object's header."""
        start = self.read(at, min(64, self.length - self.base - at))
        if start[:4] == b"OHDR":
            flags, head = start[5], _Bytes(start, 6)
            head.take(16 * bool(flags & 0x20) + 4 * bool(flags & 0x10))
            size = head.number(1 << (flags & 3))
            blocks, plain, ordered = [(at + head.at, size)], False, bool(flags & 4)
        else:
            size = int.from_bytes(start[8:12], "little")
            blocks, plain, ordered = [(at + 16, size)], True, False
        for where, size in blocks:
            data = _Bytes(self.read(where, size))
            while data.at + (8 if plain else 4 + 2 * ordered) <= size:
                kind, length = data.number(2 if plain else 1), data.number(2)
                flags = data.number(1)
                data.take(3 if plain else 2 * ordered)
                if data.at + length > size:
                    break
                content = data.take(length)
                if kind == CONTINUATION:
                    there, much = struct.unpack("<QQ", content[:16])
                    blocks.append((there, much) if plain else (there + 4, much - 8))
                elif flags & 2:
                    raise Hdf5Error("shared header messages are not read")
                else:
                    yield kind, content

    def links(self, at: int) -> dict[str, int]:
        """Names of a group's members and the addresses of their headers, in order of name."""
        found = {}
        for kind, content in self.messages(at):
            if kind == SYMBOL_TABLE:
                tree, heap = struct.unpack("<QQ", content[:16])
                names = self._heap(heap)
                found |= {names[offset : names.index(b"\0", offset)].decode(): there for offset, there in self._symbols(tree)}
            elif kind == LINK:
                data = _Bytes(content, 1)
                flags = data.number(1)
                hard = not flags & 8 or data.number(1) == 0
                data.take(8 * bool(flags & 4) + bool(flags & 16))
                name = data.take(data.number(1 << (flags & 3))).decode()
                if hard:
                    found[name] = data.number(8)
            elif kind == LINK_INFO:
                data = _Bytes(content, 1)
                data.take(8 * bool(data.number(1) & 1))
                if data.number(8) != NOWHERE:
                    raise Hdf5Error("groups with links in a fractal heap are not read")
        return dict(sorted(found.items()))

    def _heap(self, at: int) -> bytes:
        head = _Bytes(self.read(at, 32), 8)
        size, _, where = head.numbers(3)
        return self.read(where, size)

    def _symbols(self, at: int) -> Iterator[tuple[int, int]]:
        head = self.read(at, 8)
        if head[:4] == b"SNOD":
            data = _Bytes(self.read(at + 8, 40 * int.from_bytes(head[6:8], "little")))
            while data.at < len(data.raw):
                yield data.numbers(2)
                data.take(24)
        else:
            entries = int.from_bytes(head[6:8], "little")
            values = struct.unpack(f"<{2 * entries + 1}Q", self.read(at + 24, 16 * entries + 8))
            for child in values[1::2]:
                yield from self._symbols(child)

    def dataset(self, at: int) -> Dataset:
        out = Dataset(attributes={})
        for kind, content in self.messages(at):
            if kind == DATASPACE:
                out = replace(out, shape=_shape(content))
            elif kind == DATATYPE:
                out = replace(out, dtype=_dtype(content))
            elif kind == FILL_VALUE:
                out = replace(out, fill=_fill(content))
            elif kind == FILTERS:
                out = replace(out, filters=_filters(content))
            elif kind == LAYOUT:
                out = replace(out, **_layout(content))
            elif kind == ATTRIBUTE:
                _attribute(content, out.attributes)
            elif kind == ATTRIBUTE_INFO and struct.unpack("<Q", content[2 + 2 * (content[1] & 1) :][:8])[0] != NOWHERE:
                warnings.warn("attributes in a fractal heap are not read", stacklevel=2)
        return out

    # Chunks -------------------------------------------------------------------------------------------------

    def chunk_place(self, d: Dataset, at: tuple[int, ...]) -> tuple[int, int, int] | None:
        """Address, stored bytes and filter mask of the chunk at a place of the grid of chunks; None where nothing is stored."""
        bytes_ = math.prod(d.chunk) * np.dtype(d.dtype).itemsize
        if d.address == NOWHERE:
            return None
        if d.index == "single":
            return d.address, d.single[0] or bytes_, d.single[1]
        if d.index in ("implicit", "fixed"):
            grid = [-(-n // c) for n, c in zip(d.shape, d.chunk)]
            k = 0
            for g, a in zip(grid, at):
                k = k * g + a
            return (d.address + k * bytes_, bytes_, 0) if d.index == "implicit" else self._fixed(d, k, bytes_)
        offsets, node = tuple(a * c for a, c in zip(at, d.chunk)), d.address
        while True:
            level, keys, children, sizes = self._node(node, len(offsets))
            # The last key that is not beyond the wanted one leads to it.
            k = _last_at_most(keys, offsets)
            if k < 0:
                return None
            if level == 0:
                return (children[k], *sizes[k]) if keys[k] == offsets else None
            node = children[k]

    def _node(self, at: int, rank: int):
        if at not in self.nodes:
            if len(self.nodes) > 4096:
                self.nodes.clear()
            head = self.read(at, 24)
            if head[:4] != b"TREE":
                raise Hdf5Error("a chunk index is damaged")
            entries, width = int.from_bytes(head[6:8], "little"), 8 + 8 * (rank + 1) + 8
            raw = self.read(at + 24, entries * width)
            rows = [struct.unpack(f"<II{rank + 1}QQ", raw[k * width : (k + 1) * width]) for k in range(entries)]
            self.nodes[at] = head[5], [r[2 : 2 + rank] for r in rows], [r[-1] for r in rows], [r[:2] for r in rows]
        return self.nodes[at]

    def _fixed(self, d: Dataset, k: int, bytes_: int) -> tuple[int, int, int] | None:
        head = _Bytes(self.read(d.address, 28), 5)
        filtered, width, bits = head.numbers(3, 1)
        entries, block = head.numbers(2)
        start, per_page = block + 14, 1 << bits
        if entries > per_page:
            pages = -(-entries // per_page)
            page = k // per_page
            bitmap = self.read(start, -(-pages // 8))
            if not bitmap[page // 8] & (0x80 >> page % 8):
                return None
            start += len(bitmap) + 4 + page * (per_page * width + 4)
            k %= per_page
        data = _Bytes(self.read(start + k * width, width))
        address = data.number(8)
        if address == NOWHERE:
            return None
        return (address, data.number(width - 12), data.number(4)) if filtered else (address, bytes_, 0)

    def chunk(self, d: Dataset, at: tuple[int, ...]) -> np.ndarray:
        """The values of a chunk, whole even where it passes the end of the data."""
        dtype = np.dtype(d.dtype)
        if (place := self.chunk_place(d, at)) is None:
            fill = np.frombuffer(d.fill, dtype)[0] if len(d.fill) == dtype.itemsize else 0
            return np.full(d.chunk, fill, dtype)
        address, size, mask = place
        raw = self.read(address, size)
        for k in reversed(range(len(d.filters))):
            kind, values = d.filters[k]
            if mask >> k & 1:
                continue
            if kind == DEFLATE:
                raw = zlib.decompress(raw)
            elif kind == SHUFFLE:
                width = values[0] if values else dtype.itemsize
                whole = len(raw) // width * width
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(width, -1).T.tobytes() + raw[whole:]
            elif kind == FLETCHER32:
                raw = raw[:-4]
            else:
                raise Hdf5Error(f"filter {kind} is not read")
        return np.frombuffer(raw, dtype, math.prod(d.chunk)).reshape(d.chunk)

    def stretch(self, d: Dataset, at: tuple[int, ...], size: tuple[int, ...]) -> np.ndarray:
        """The values of a box of contiguous or compact data whose axes behind the first longer one are whole."""
        dtype, first = np.dtype(d.dtype), 0
        for n, a in zip(d.shape, at):
            first = first * n + a
        count = math.prod(size)
        if d.kind == "compact":
            return np.frombuffer(d.inline, dtype, count, first * dtype.itemsize).reshape(size)
        if d.address == NOWHERE:
            return np.full(size, np.frombuffer(d.fill, dtype)[0] if len(d.fill) == dtype.itemsize else 0, dtype)
        return np.frombuffer(self.read(d.address + first * dtype.itemsize, count * dtype.itemsize), dtype).reshape(size)

    def small(self, d: Dataset) -> np.ndarray:
        """All values of a small dataset."""
        if d.kind != "chunked":
            return self.stretch(d, (0,) * len(d.shape), d.shape)
        out = np.empty(d.shape, np.dtype(d.dtype))
        for at in np.ndindex(*[-(-n // c) for n, c in zip(d.shape, d.chunk)]):
            box = tuple(slice(a * c, min((a + 1) * c, n)) for a, c, n in zip(at, d.chunk, d.shape))
            out[box] = self.chunk(d, at)[tuple(slice(0, b.stop - b.start) for b in box)]
        return out


def _last_at_most(keys: list[tuple[int, ...]], wanted: tuple[int, ...]) -> int:
    low, high = 0, len(keys)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if keys[mid] <= wanted else (low, mid)
    return low - 1


def _shape(raw: bytes) -> tuple[int, ...]:
    data = _Bytes(raw)
    version, rank, _ = data.numbers(3, 1)
    data.take(5 if version == 1 else 1)
    return data.numbers(rank)


def _dtype(raw: bytes) -> str | None:
    """A NumPy name of an integer or floating-point type; None of others."""
    kind, bits, size = raw[0] & 15, raw[1], int.from_bytes(raw[4:8], "little")
    order = ">" if bits & 1 else "<"
    if kind == 0 and size in (1, 2, 4, 8):
        return f"{order}{'i' if bits & 8 else 'u'}{size}"
    return f"{order}f{size}" if kind == 1 and size in (2, 4, 8) and not bits & 0x40 else None


def _fill(raw: bytes) -> bytes:
    if raw[0] in (1, 2):
        if raw[0] == 2 and not raw[3]:
            return b""
        return raw[8 : 8 + int.from_bytes(raw[4:8], "little")]
    return raw[6 : 6 + int.from_bytes(raw[2:6], "little")] if raw[0] == 3 and raw[1] & 0x20 else b""


def _filters(raw: bytes) -> tuple[tuple[int, tuple[int, ...]], ...]:
    data, out = _Bytes(raw), []
    version, count = data.numbers(2, 1)
    data.take(6 if version == 1 else 0)
    for _ in range(count):
        kind = data.number(2)
        name = data.number(2) if version == 1 or kind >= 256 else 0
        data.take(2)
        values = data.number(2)
        data.take(-(-name // 8) * 8 if version == 1 else name)
        out.append((kind, data.numbers(values, 4)))
        data.take(4 if version == 1 and values % 2 else 0)
    return tuple(out)


def _layout(raw: bytes) -> dict:
    version = raw[0]
    if version not in (3, 4):
        raise Hdf5Error(f"data layout of version {version}")
    data = _Bytes(raw, 2)
    if raw[1] == 0:
        return {"kind": "compact", "inline": data.take(data.number(2))}
    if raw[1] == 1:
        return {"kind": "contiguous", "address": data.number(8), "size": data.number(8)}
    if raw[1] != 2:
        raise Hdf5Error("virtual datasets are not read")
    if version == 3:
        rank = data.number(1)
        address = data.number(8)
        return {"kind": "chunked", "index": "btree", "address": address, "chunk": data.numbers(rank - 1, 4)}
    flags, rank, width = data.numbers(3, 1)
    chunk = data.numbers(rank, width)[:-1]
    kind = data.number(1)
    name = {1: "single", 2: "implicit", 3: "fixed"}.get(kind)
    if name is None:
        raise Hdf5Error(f"chunk index of kind {kind} (data that may grow) is not read")
    single = (data.number(8), data.number(4)) if kind == 1 and flags & 2 else (0, 0)
    data.take(1 if kind == 3 else 0)
    return {"kind": "chunked", "index": name, "address": data.number(8), "chunk": chunk, "single": single}


def _attribute(raw: bytes, into: dict[str, list[float]]) -> None:
    """Add an attribute if it is one or several numbers."""
    data = _Bytes(raw)
    version, _ = data.numbers(2, 1)
    sizes = data.numbers(3, 2)
    data.take(1 if version == 3 else 0)
    parts = []
    for n in sizes:
        start = data.at
        parts.append(data.take(n))
        if version == 1:
            data.pad(start)
    dtype, shape = _dtype(parts[1]), _shape(parts[2])
    if dtype:
        into[parts[0].rstrip(b"\0").decode()] = np.frombuffer(raw, dtype, math.prod(shape), data.at).astype(float).tolist()


# Description ------------------------------------------------------------------------------------------------


def find(file: Hdf5File, name: str | None) -> tuple[str, Dataset]:
    """The dataset of a name, else of the usual names, else the first array."""
    links = file.links(file.root)
    for candidate in (name,) if name else DATA_NAMES:
        if candidate in links and (d := file.dataset(links[candidate])).is_array:
            return candidate, d
    if name is None:
        for candidate, at in links.items():
            if (d := file.dataset(at)).is_array:
                return candidate, d
    raise KeyError(f"no array dataset {name or 'at all'} in {file.path}: {list(links)}")


def describe(path: str, name: str | None = None) -> dict:
    """Name and shape of the data, and the grid as the file tells it: a dataset, else an attribute of the file, else of the data; hints likewise."""
    file = Hdf5File(path)
    name, d = find(file, name)
    links, rank = file.links(file.root), len(d.shape)
    own = file.dataset(file.root).attributes
    out = {"dataset": name, "shape": d.shape, "chunk": d.chunk, "usual": name in DATA_NAMES}
    for what, hints in (("spacing", SPACING_HINTS), ("origin", ("origin",))):
        found = None
        if what in links and (values := file.dataset(links[what])).dtype and math.prod(values.shape) <= 64:
            found = file.small(values).astype(float).ravel().tolist()
        for h in hints:
            found = found or own.get(h) or d.attributes.get(h)
        out[what] = None if not found else found * rank if len(found) == 1 else found
    file.close()
    return out


def open_hdf5(spark: SparkSession, path: str, dataset: str | None = None, spacing=None, origin=None) -> Field:
    """A dataset of an HDF5 file as a scalar field, lazily: slices reach the scan and leave out chunks.

    The dataset is that of the name, else ``field``, ``data`` or the first array (with a warning). Spacing and origin are the file's, else the
    arguments, else 1 (with a warning) and 0.
    """
    from pyspark.sql import Row

    register(spark)
    # One task reads the headers where the data can be read.
    run = lambda batches: (pa.RecordBatch.from_pydict({"about": [json.dumps(describe(path, dataset))]}) for b in batches if b.num_rows)
    found: Row = spark.range(1, numPartitions=1).mapInArrow(run, "about string").first()
    about = json.loads(found.about)
    if not about["usual"] and dataset is None:
        warnings.warn(f"values are taken from dataset {about['dataset']!r}", stacklevel=2)
    rank = len(about["shape"])
    steps = about["spacing"] or spacing
    if steps is None:
        warnings.warn("no spacing is given or found; 1.0 is used", stacklevel=2)
    steps = (float(steps),) * rank if isinstance(steps, (int, float)) else tuple(steps or ())
    df = spark.read.format("fieldweave_hdf5").options(path=path, dataset=about["dataset"], shape=json.dumps(about["shape"])).load()
    return Field(df, tuple(about["shape"]), spacing=steps, origin=tuple(about["origin"] or origin or ()), in_order=True)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let filters on coordinates reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Hdf5Source)


# Reading ----------------------------------------------------------------------------------------------------


@dataclass
class ChunkRange(InputPartition):
    """Chunks from ``first`` to before ``last`` of the box of chunks that a scan reads, in order of rows."""

    first: int
    last: int


class Hdf5Source(DataSource):
    """``spark.read.format("fieldweave_hdf5").option("path", ..).option("dataset", ..)``: coordinates i0.. and v; writing takes such rows and the option ``about``."""

    @classmethod
    def name(cls) -> str:
        return "fieldweave_hdf5"

    def _given_shape(self) -> list[int]:
        return json.loads(self.options["shape"]) if "shape" in self.options else describe(self.options["path"], self.options.get("dataset"))["shape"]

    def schema(self) -> str:
        return ", ".join([f"{c} int" for c in coords(len(self._given_shape()))] + ["v double"])

    def reader(self, schema) -> Hdf5Reader:
        return Hdf5Reader(self.options["path"], self.options.get("dataset"), len(schema.fields) - 1)

    def writer(self, schema, overwrite: bool) -> Hdf5Writer:
        return Hdf5Writer(self.options["path"], json.loads(self.options["about"]), overwrite)


class Hdf5Reader(DataSourceReader):
    def __init__(self, path: str, dataset: str | None, rank: int):
        self.path, self.dataset = path, dataset
        self.low, self.high = [0] * rank, [None] * rank

    def pushFilters(self, filters):
        """Keep bounds of coordinates; all other filters stay with Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", ()) else ""
            known = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int) and name[:1] == "i" and name[1:].isdigit()
            if not known:
                yield f
                continue
            d, x = int(name[1:]), f.value
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low[d] = max(self.low[d], x + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                end = x + (not isinstance(f, LessThan))
                self.high[d] = end if self.high[d] is None else min(self.high[d], end)

    @cached_property
    def _scan(self) -> Scan:
        file = Hdf5File(self.path)
        _, d = find(file, self.dataset)
        file.close()
        return Scan(d, self.low, self.high)

    def partitions(self):
        n, cells = self._scan.chunks, self._scan.chunk_cells
        each = max(1, PARTITION_CELLS // max(cells, 1), -(-n // MOST_PARTITIONS))
        return [ChunkRange(k, min(k + each, n)) for k in range(0, n, each)] or [ChunkRange(0, 0)]

    def read(self, partition):
        scan = self._scan
        file = Hdf5File(self.path)
        for k in range(partition.first, partition.last):
            yield from scan.batches(file, k)
        file.close()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_scan"}


class Scan:
    """The box of chunks that hold the wanted cells of a dataset, in order of rows."""

    def __init__(self, d: Dataset, low: list[int], high: list[int | None]):
        self.d = d
        self.chunk = d.chunk if d.kind == "chunked" else stretch_shape(d.shape, np.dtype(d.dtype).itemsize)
        self.low = [max(0, a) for a in low]
        self.high = [n if b is None else min(b, n) for b, n in zip(high, d.shape)]
        self.first = [a // c for a, c in zip(self.low, self.chunk)]
        self.grid = [max(0, -(-b // c) - f) if b > a else 0 for a, b, c, f in zip(self.low, self.high, self.chunk, self.first)]
        self.chunks, self.chunk_cells = math.prod(self.grid), math.prod(self.chunk)

    def batches(self, file: Hdf5File, k: int) -> Iterator[pa.RecordBatch]:
        """The wanted cells of the k-th chunk."""
        at = tuple(int(x) + f for x, f in zip(np.unravel_index(k, self.grid), self.first))
        start = [a * c for a, c in zip(at, self.chunk)]
        begin = [max(a, s) for a, s in zip(self.low, start)]
        size = [min(b, s + c) - a for a, b, s, c in zip(begin, self.high, start, self.chunk)]
        if self.d.kind == "chunked":
            values = file.chunk(self.d, at)
        else:
            values = file.stretch(self.d, tuple(start), tuple(min(c, n - s) for c, n, s in zip(self.chunk, self.d.shape, start)))
        values = values[tuple(slice(a - s, a - s + n) for a, s, n in zip(begin, start, size))].ravel().astype(np.float64)
        inner = [math.prod(size[d + 1 :]) for d in range(len(size))]
        for row in range(0, len(values), BATCH_CELLS):
            place = np.arange(row, min(row + BATCH_CELLS, len(values)))
            axes = [(place // n % m + a).astype(np.int32) for n, m, a in zip(inner, size, begin)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, axes), pa.array(values[row : row + BATCH_CELLS])], names=[*coords(len(size)), "v"])


def stretch_shape(shape: tuple[int, ...], width: int) -> tuple[int, ...]:
    """A box of contiguous data of about STRETCH_BYTES: whole inner axes, some rows of the next, single ones of those outside."""
    out, inner, free = [], width, True
    for n in reversed(shape):
        take = max(1, min(n, STRETCH_BYTES // inner)) if free else 1
        free = free and take == n
        inner *= n
        out.append(take)
    return tuple(reversed(out))


# Writing ----------------------------------------------------------------------------------------------------


def save_hdf5(field: Field, path: str, mode: str = "overwrite") -> str:
    """Write a scalar field as one HDF5 file: datasets ``field`` (float64, contiguous), ``spacing`` and ``origin``.

    Every cell must be there exactly once, else it raises and leaves no file of that name. The path lies in a file system that all executors mount.
    """
    if field.kind != "scalar":
        raise ValueError("an HDF5 file takes a scalar field; write components one by one")
    local_path(path)
    register(field.df.sparkSession)
    at = coords(field.ndim)
    rows = field.df.select(*[F.col(c).cast("int").alias(c) for c in at], F.col("v").cast("double").alias("v"))
    about = {"shape": field.shape, "spacing": field.spacing, "origin": field.origin, "run": uuid.uuid4().hex}
    sorted_rows = rows.repartitionByRange("i0", *at[1:2]).sortWithinPartitions(*at)
    sorted_rows.write.format("fieldweave_hdf5").mode("overwrite" if mode == "overwrite" else "append").options(path=path, about=json.dumps(about)).save()
    return path


def local_path(path: str) -> str:
    """The path in a mounted file system."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: HDF5 files are written in place, which needs a file system that all executors mount")
    return "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else os.path.abspath(path)


@dataclass
class Written(WriterCommitMessage):
    cells: int


class Hdf5Writer(DataSourceArrowWriter):
    def __init__(self, path: str, about: dict, overwrite: bool):
        self.path, self.about = local_path(path), about
        if not overwrite and os.path.exists(self.path):
            raise FileExistsError(self.path)
        self.partial = f"{self.path}.{about['run']}.partial"
        head, self.data_at = header(about["shape"], about["spacing"], about["origin"])
        self.head = head

    def write(self, iterator) -> Written:
        shape, cells = self.about["shape"], 0
        os.makedirs(os.path.dirname(self.partial), exist_ok=True)
        file = os.open(self.partial, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            for batch in iterator:
                axes = [batch.column(d).to_numpy() for d in range(len(shape))]
                if any(len(a) and (a.min() < 0 or a.max() >= n) for a, n in zip(axes, shape)):
                    raise ValueError(f"coordinates outside of the shape {shape}")
                place = np.zeros(batch.num_rows, np.int64)
                for a, n in zip(axes, shape):
                    place = place * n + a
                order = np.argsort(place, kind="stable")
                place, values = place[order], batch.column(len(shape)).to_numpy(zero_copy_only=False).astype("<f8")[order]
                cuts = np.flatnonzero(np.diff(place) != 1) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                    if b > a:
                        os.pwrite(file, values[a:b].tobytes(), self.data_at + 8 * int(place[a]))
                cells += len(place) - int((np.diff(place) == 0).sum())
        finally:
            os.close(file)
        return Written(cells)

    def commit(self, messages) -> None:
        cells = sum(m.cells for m in messages if m is not None)
        if cells != math.prod(self.about["shape"]):
            self.abort(messages)
            raise ValueError(f"{cells} cells were written, the shape {self.about['shape']} holds {math.prod(self.about['shape'])}")
        with open(self.partial, "r+b") as file:
            file.write(self.head)
        os.replace(self.partial, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.partial):
            os.remove(self.partial)


def _message(kind: int, content: bytes) -> bytes:
    content += b"\0" * (-len(content) % 8)
    return struct.pack("<HHB3x", kind, len(content), 0) + content


def _object(*messages: bytes) -> bytes:
    body = b"".join(messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body


def _float_dataset(shape, address: int) -> bytes:
    bytes_ = 8 * math.prod(shape)
    return _object(
        _message(DATASPACE, struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)),
        _message(DATATYPE, struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, 63, 0, 8, 0, 64, 52, 11, 0, 52, 1023)),
        _message(FILL_VALUE, struct.pack("<BBBBI", 2, 2, 2, 1, 0)),
        _message(LAYOUT, struct.pack("<BBQQ", 3, 1, address, bytes_)),
    )


def header(shape, spacing, origin) -> tuple[bytes, int]:
    """Everything of a file but the data of ``field``, and where that begins."""
    small = {"origin": origin, "spacing": spacing}
    names = ["field", "origin", "spacing"]
    heap, offsets = b"\0" * 8, {}
    for name in names:
        offsets[name] = len(heap)
        heap += name.encode().ljust(8, b"\0")
    # Sizes do not depend on addresses, so places are known before anything is laid out.
    root_at, tree_at = 96, 96 + 40
    heap_at = tree_at + 24 + 33 * 8 + 32 * 8
    names_at = heap_at + 32
    table_at = names_at + len(heap)
    at, places = table_at + 8 + 8 * 40, {}
    for name in names:
        places[name] = at
        at += len(_float_dataset(shape if name == "field" else (len(shape),), 0))
    data = {}
    for name in small:
        data[name], at = at, at + 8 * len(shape)
    data["field"] = -(-at // 4096) * 4096
    end = data["field"] + 8 * math.prod(shape)
    out = bytearray(data["field"])

    def put(where: int, raw: bytes) -> None:
        out[where : where + len(raw)] = raw

    symbol = struct.pack("<QQII", 0, root_at, 1, 0) + struct.pack("<QQ", tree_at, heap_at)
    put(0, SIGNATURE + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, end, NOWHERE) + symbol)
    put(root_at, _object(_message(SYMBOL_TABLE, struct.pack("<QQ", tree_at, heap_at))))
    put(tree_at, b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, table_at, offsets[names[-1]]))
    put(heap_at, b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, names_at))
    put(names_at, heap)
    put(table_at, b"SNOD" + struct.pack("<BxH", 1, len(names)) + b"".join(struct.pack("<QQII16x", offsets[n], places[n], 0, 0) for n in names))
    for name in names:
        put(places[name], _float_dataset(shape if name == "field" else (len(shape),), data[name]))
    for name, values in small.items():
        put(data[name], struct.pack(f"<{len(shape)}d", *values))
    return bytes(out), data["field"]
