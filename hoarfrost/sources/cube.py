"""Cubes as a Spark data source: Zarr (version 2) stores and classic NetCDF files, read and written chunk by chunk.

``spark.read.format("cube").load(path)`` gives a row a cell: a column for each
dimension, with the values of its axis, and one for each variable. A partition
is a chunk. The options ``from.<dimension>`` and ``to.<dimension>`` (inclusive;
dates and times as ISO text) leave out all cells beyond, and no chunk without
cells within is opened. The option ``variables`` (names joined by commas)
chooses what is read. With ``pushdown`` filters on dimensions choose chunks as
well; it is off by default, since Spark 4.1 keeps what is pushed down by table:
a frame that is read twice in a plan with different filters would lose rows. Stores are reached through pyarrow's file systems (local or
mounted folders, hdfs, s3, gs), from the tasks themselves.

Writing makes a store beside the old one and puts it in its place when all
tasks are done, so a job that fails leaves what was there.
"""

from __future__ import annotations

import bz2
import datetime
import gzip
import json
import lzma
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Rows of the Arrow batches that a chunk is given out in.
BATCH_CELLS = 1 << 16
#: Bytes of the slabs that a classic file, which has no chunks, is read in.
SLAB_BYTES = 8 << 20
#: Values of an axis at most: axes are the store's own description and pass through the driver.
AXIS_VALUES = 1 << 20
_SINCE = re.compile(r"\s*(microseconds?|milliseconds?|seconds?|minutes?|hours?|days?)\s+since\s+(\S+(?:[ T]\S+)?)")
_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
_UNPACK = {
    "zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress,
    "zstd": lambda data: zstandard.ZstdDecompressor().decompressobj().decompress(data),
}
_PACK = {"zlib": lambda data: zlib.compress(data, 4), "gzip": lambda data: gzip.compress(data, 4, mtime=0), "zstd": lambda data: zstandard.ZstdCompressor(level=3).compress(data)}
_KINDS = {"f4": T.FloatType(), "f8": T.DoubleType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType()}


@dataclass(frozen=True)
class Variable:
    """An array of a cube: its dimensions, shape, type, chunks and attributes. where: what its store needs to find it."""

    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: np.dtype
    chunks: tuple[int, ...]
    attrs: dict = field(default_factory=dict)
    where: dict = field(default_factory=dict)

    @property
    def unpacked(self) -> bool:
        """Whether values are stored as numbers to be scaled."""
        return "scale_factor" in self.attrs or "add_offset" in self.attrs

    def nulls(self, values: np.ndarray) -> np.ndarray:
        """Where stored values mean none."""
        none = np.isnan(values) if values.dtype.kind == "f" else np.zeros(values.shape, bool)
        for name in ("_FillValue", "missing_value"):
            for mark in np.atleast_1d(self.attrs.get(name, [])).tolist():
                if not (isinstance(mark, float) and math.isnan(mark)):
                    none |= values == np.asarray(mark).astype(values.dtype)
        return none

    def decoded(self, values: np.ndarray) -> np.ndarray:
        """Stored values, scaled where the attributes say so."""
        if not self.unpacked:
            return values.astype(values.dtype.newbyteorder("="))
        return values.astype(np.float64) * float(np.ravel(self.attrs.get("scale_factor", 1.0))[0]) + float(np.ravel(self.attrs.get("add_offset", 0.0))[0])

    def kind(self) -> T.DataType:
        if self.unpacked:
            return T.DoubleType()
        return _KINDS.get(self.dtype.str[1:], T.IntegerType() if self.dtype.itemsize == 1 or self.dtype.str[1:] == "u2" else T.LongType())


def placed(path: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    path = path.rstrip("/")
    return afs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _read(fs: afs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path) as f:
        return f.read()


def _there(fs: afs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != afs.FileType.NotFound


class Zarr:
    """A Zarr store of version 2: a folder for each array, a file for each chunk."""

    def __init__(self, path: str):
        self.fs, self.path = placed(path)
        self.variables: dict[str, Variable] = {}
        if _there(self.fs, f"{self.path}/.zmetadata"):
            meta = json.loads(_read(self.fs, f"{self.path}/.zmetadata"))["metadata"]
        else:
            found = [i for i in self.fs.get_file_info(afs.FileSelector(self.path)) if i.type == afs.FileType.Directory]
            meta = {f"{i.base_name}/{n}": json.loads(_read(self.fs, f"{i.path}/{n}")) for i in found for n in (".zarray", ".zattrs") if _there(self.fs, f"{i.path}/{n}")}
        for key, m in meta.items():
            name, _, last = key.rpartition("/")
            if last != ".zarray" or not name:
                continue
            attrs = dict(meta.get(f"{name}/.zattrs", {}))
            dims = tuple(attrs.pop("_ARRAY_DIMENSIONS", [f"dim{k}" for k in range(len(m["shape"]))]))
            if m.get("filters") or (m["compressor"] or {}).get("id", "zlib") not in _UNPACK:
                raise ValueError(f"{path}: {name} has a compressor or filter that can't be read: {m['compressor']}, {m.get('filters')}")
            self.variables[name] = Variable(name, dims, tuple(m["shape"]), np.dtype(m["dtype"]), tuple(m["chunks"]), attrs, m)

    def chunk(self, v: Variable, number: tuple[int, ...]) -> np.ndarray:
        """A chunk as stored, whole even at the border; one without a file is the fill value."""
        name = v.where.get("dimension_separator", ".").join(map(str, number)) or "0"
        try:
            data = _read(self.fs, f"{self.path}/{v.name}/{name}")
        except FileNotFoundError:
            fill = v.where.get("fill_value")
            return np.full(v.chunks, {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf, None: 0}.get(fill, fill), v.dtype)
        if v.where["compressor"]:
            data = _UNPACK[v.where["compressor"]["id"]](data)
        return np.frombuffer(data, v.dtype).reshape(v.chunks, order=v.where.get("order", "C"))

    def region(self, v: Variable, start: tuple[int, ...], stop: tuple[int, ...]) -> np.ndarray:
        """Stored values between two corners, from just the chunks that are met."""
        out = np.empty([b - a for a, b in zip(start, stop)], v.dtype)
        for number in product(*[range(a // c, -(-b // c)) for a, b, c in zip(start, stop, v.chunks)]):
            lo = [max(a, n * c) for a, n, c in zip(start, number, v.chunks)]
            hi = [min(b, (n + 1) * c) for b, n, c in zip(stop, number, v.chunks)]
            inside = tuple(slice(a - n * c, b - n * c) for a, b, n, c in zip(lo, hi, number, v.chunks))
            out[tuple(slice(a - s, b - s) for a, b, s in zip(lo, hi, start))] = self.chunk(v, number)[inside]
        return out


class Classic:
    """A classic NetCDF file (versions 1, 2 and 5): arrays in big-endian order behind a header, record variables interleaved."""

    _TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}

    def __init__(self, path: str):
        self.fs, self.path = placed(path)
        with self.fs.open_input_file(self.path) as f:
            self._f = f
            magic = f.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
                raise ValueError(f"{path} is no classic NetCDF file")
            self._wide, self._far = magic[3] == 5, magic[3] >= 2
            records = self._count()
            dims = [(self._name(), self._count()) for _ in range(self._listed())]
            self._attrs()
            found = []
            for _ in range(self._listed()):
                name = self._name()
                ids = [self._count() for _ in range(self._count())]
                attrs, kind = self._attrs(), self._TYPES[self._int()]
                self._count()  # the size, which can't be told for large variables
                begin = self._int(8 if self._far else 4)
                found.append((name, ids, attrs, np.dtype(kind), begin))
            del self._f
        self.variables: dict[str, Variable] = {}
        size = lambda ids, kind: kind.itemsize * math.prod(dims[d][1] for d in ids)
        inner = [size(ids[1:], kind) for _, ids, _, kind, _ in found if ids and dims[ids[0]][1] == 0]
        record = inner[0] if len(inner) == 1 else sum(-(-n // 4) * 4 for n in inner)
        for name, ids, attrs, kind, begin in found:
            grows = bool(ids) and dims[ids[0]][1] == 0
            shape = tuple(records if dims[d][1] == 0 else dims[d][1] for d in ids)
            row = size(ids[1:], kind)
            chunks = (max(1, min(shape[0], SLAB_BYTES // max(1, row))), *shape[1:]) if shape else ()
            self.variables[name] = Variable(name, tuple(dims[d][0] for d in ids), shape, kind, chunks, attrs, {"begin": begin, "row": row, "step": record if grows else row})

    def _int(self, n: int = 4) -> int:
        return int.from_bytes(self._f.read(n), "big")

    def _count(self) -> int:
        return self._int(8 if self._wide else 4)

    def _padded(self, n: int) -> bytes:
        return self._f.read(-(-n // 4) * 4)[:n]

    def _name(self) -> str:
        return self._padded(self._count()).decode()

    def _listed(self) -> int:
        self._int()  # the list's tag
        return self._count()

    def _attrs(self) -> dict:
        out = {}
        for _ in range(self._listed()):
            name, kind = self._name(), np.dtype(self._TYPES[self._int()])
            n = self._count()
            data = self._padded(n * kind.itemsize)
            values = np.frombuffer(data, kind).tolist()
            out[name] = data.decode("utf-8", "replace") if kind == "S1" else values[0] if n == 1 else values
        return out

    def region(self, v: Variable, start: tuple[int, ...], stop: tuple[int, ...]) -> np.ndarray:
        """Stored values between two corners: the rows of the first dimension that are met are read whole."""
        w = v.where
        with self.fs.open_input_file(self.path) as f:
            if not v.shape:
                f.seek(w["begin"])
                return np.frombuffer(f.read(v.dtype.itemsize), v.dtype).reshape(())
            n = stop[0] - start[0]
            f.seek(w["begin"] + start[0] * w["step"])
            if w["step"] == w["row"]:
                data = f.read(n * w["row"])
            else:
                rows = []
                for k in range(start[0], stop[0]):
                    f.seek(w["begin"] + k * w["step"])
                    rows.append(f.read(w["row"]))
                data = b"".join(rows)
        return np.frombuffer(data, v.dtype).reshape(n, *v.shape[1:])[(slice(None), *(slice(a, b) for a, b in zip(start[1:], stop[1:])))]


def opened(path: str) -> Zarr | Classic:
    """The cube at a path: a folder is a Zarr store, a file a classic NetCDF one."""
    fs, at = placed(path)
    kind = fs.get_file_info(at).type
    if kind == afs.FileType.NotFound:
        raise FileNotFoundError(path)
    return Zarr(path) if kind == afs.FileType.Directory else Classic(path)


class Cube:
    """Some variables of one shape, and their axes' values."""

    def __init__(self, path: str, variables: str | None = None):
        self.store = opened(path)
        of = self.store.variables
        data = [v for v in of.values() if v.dims and v.dims != (v.name,)]
        if variables:
            wanted = [x.strip() for x in variables.split(",")]
            missing = [x for x in wanted if x not in of]
            if missing:
                raise ValueError(f"{path} has no variables {missing}, only {sorted(of)}")
            data = [of[x] for x in wanted]
        elif data:
            most = max(data, key=lambda v: len(v.dims)).dims
            data = [v for v in data if v.dims == most]
        if not data or any(v.dims != data[0].dims or v.shape != data[0].shape for v in data):
            raise ValueError(f"{path}: choose variables of the same dimensions; it has " + ", ".join(f"{v.name}{v.dims}" for v in of.values()))
        self.data, self.dims, self.shape = data, data[0].dims, data[0].shape

    @cached_property
    def axes(self) -> dict[str, np.ndarray]:
        """Each dimension's values: dates for whole days since a day, timestamps for other times, numbers otherwise, and numbers from 0 where there is no axis."""
        return {d: self._axis(d, n) for d, n in zip(self.dims, self.shape)}

    def _axis(self, name: str, n: int) -> np.ndarray:
        v = self.store.variables.get(name)
        if v is None or v.dims != (name,):
            return np.arange(n)
        values = v.decoded(self.store.region(v, (0,), v.shape))
        since = _SINCE.match(str(v.attrs.get("units", "")))
        if not since:
            return values
        unit, base = since[1].removesuffix("s"), np.datetime64(since[2].rstrip("Z").replace(" ", "T"), "us")
        if unit == "day" and np.equal(np.mod(values, 1), 0).all() and base == base.astype("M8[D]"):
            return base.astype("M8[D]") + values.astype(np.int64)
        count = values.astype(np.int64) if values.dtype.kind in "iu" else values
        return base + np.round(count * _UNITS[unit]).astype(np.int64).astype("m8[us]")

    def schema(self) -> T.StructType:
        def kind(axis: np.ndarray) -> T.DataType:
            return {"M": T.DateType() if axis.dtype == "M8[D]" else T.TimestampNTZType()}.get(axis.dtype.kind) or _KINDS.get(axis.dtype.str[1:], T.LongType())

        return T.StructType([T.StructField(d, kind(a), False) for d, a in self.axes.items()] + [T.StructField(v.name, v.kind()) for v in self.data])


@dataclass
class Chunk(InputPartition):
    start: tuple[int, ...]
    stop: tuple[int, ...]


def _like(axis: np.ndarray, x):
    """A value to be compared with an axis; dates and times may be text."""
    return np.datetime64(x).astype(axis.dtype) if axis.dtype.kind == "M" else axis.dtype.type(x) if axis.dtype.kind == "f" else float(x) if isinstance(x, str) else x


class CubeReader(DataSourceReader):
    """Reads the cells whose axes' values are chosen; without pushdown those of the options from.* and to.*."""

    def __init__(self, cube: Cube, options: dict[str, str]):
        self.cube = cube
        self.chosen = {d: np.ones(n, bool) for d, n in zip(cube.dims, cube.shape)}
        dims = {d.lower(): d for d in cube.dims}
        for key, value in options.items():
            side, _, name = key.lower().partition(".")
            if side in ("from", "to") and name:
                if name not in dims:
                    raise ValueError(f"{name} is no dimension; there are {list(cube.dims)}")
                axis = cube.axes[dims[name]]
                self.chosen[dims[name]] &= (np.greater_equal if side == "from" else np.less_equal)(axis, _like(axis, value))
        cube.axes  # read once, on the driver

    def partitions(self):
        v = self.cube.data[0]
        met = [[n for n in range(-(-size // c)) if self.chosen[d][n * c : (n + 1) * c].any()] for d, size, c in zip(v.dims, v.shape, v.chunks)]
        return [Chunk(tuple(n * c for n, c in zip(at, v.chunks)), tuple(min(size, (n + 1) * c) for n, c, size in zip(at, v.chunks, v.shape))) for at in product(*met)] or [Chunk((0,) * len(v.shape), (0,) * len(v.shape))]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        cube = self.cube
        picks = [np.flatnonzero(self.chosen[d][a:b]) for d, a, b in zip(cube.dims, partition.start, partition.stop)]
        if not all(len(p) for p in picks):
            return
        values = []
        for v in cube.data:
            stored = cube.store.region(v, partition.start, partition.stop)[np.ix_(*picks)]
            values.append((v.decoded(stored), v.nulls(stored)))
        axes = [cube.axes[d][a:b][p] for d, a, b, p in zip(cube.dims, partition.start, partition.stop, picks)]
        shape = tuple(map(len, axes))
        kinds = {"M8[D]": pa.date32(), "M8[us]": pa.timestamp("us")}
        for at in range(0, math.prod(shape), BATCH_CELLS):
            cells = np.arange(at, min(at + BATCH_CELLS, math.prod(shape)))
            index = np.unravel_index(cells, shape)
            columns = [pa.array(a[i], kinds.get(a.dtype.str[1:])) for a, i in zip(axes, index)]
            columns += [pa.array(x.reshape(-1)[cells], mask=none.reshape(-1)[cells]).cast(_arrow(v.kind())) for v, (x, none) in zip(cube.data, values)]
            yield pa.RecordBatch.from_arrays(columns, names=[*cube.dims, *[v.name for v in cube.data]])


class PushedReader(CubeReader):
    """Filters choose cells as well."""

    def pushFilters(self, filters):
        """Comparisons of a dimension with values choose its indices; Spark checks all filters again."""
        ways = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.chosen and (type(f) in ways or isinstance(f, In)):
                axis = self.cube.axes[name]
                try:
                    self.chosen[name] &= np.isin(axis, [_like(axis, x) for x in f.value if x is not None]) if isinstance(f, In) else ways[type(f)](axis, _like(axis, f.value))
                except (TypeError, ValueError):
                    pass  # a value of another type: Spark alone decides
            yield f


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"float": pa.float32(), "double": pa.float64(), "short": pa.int16(), "integer": pa.int32(), "long": pa.int64()}[kind.typeName()]


@dataclass
class Written(WriterCommitMessage):
    chunks: int


def _json(x) -> bytes:
    return json.dumps(x, indent=1).encode()


class CubeWriter(DataSourceArrowWriter):
    """Writes rows (index of each dimension, variables), all of a chunk behind each other, as chunks of a new store, which takes the old one's place, or whose variables the old one gets, at the end."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.axes = json.loads(options["axes"])  # dimension -> values, type and attributes
        self.dims = list(self.axes)
        self.shape = [len(a["values"]) for a in self.axes.values()]
        self.chunks = [min(n, c) if n else c for n, c in zip(self.shape, json.loads(options["chunks"]))]
        self.pack, self.attrs = options.get("compression", "zlib"), json.loads(options.get("attrs", "{}"))
        self.kinds = {f.name: np.dtype({"float": "<f4", "double": "<f8", "short": "<i2", "integer": "<i4", "long": "<i8"}[f.dataType.typeName()]) for f in schema.fields[len(self.dims) :]}
        self.new = f"{self.path}.new-{uuid.uuid4().hex}"

    def _fill(self, name: str):
        return math.nan if self.kinds[name].kind == "f" else int(np.iinfo(self.kinds[name]).min)

    def _put(self, fs, path: str, data: bytes) -> None:
        """A file that is there whole or not at all, whichever attempt of a task writes it."""
        aside = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as f:
            f.write(data)
        fs.move(aside, path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, new = placed(self.new)
        for name in self.kinds:
            fs.create_dir(f"{new}/{name}")
        grid = [-(-n // c) for n, c in zip(self.shape, self.chunks)]
        now, done, arrays, seen = None, 0, {}, None

        def flush() -> None:
            for name, a in arrays.items():
                data = a.tobytes()
                self._put(fs, f"{new}/{name}/" + ".".join(map(str, np.unravel_index(now, grid))), _PACK[self.pack](data) if self.pack != "none" else data)

        for b in iterator:
            index = []
            for k, d in enumerate(self.dims):
                if b.column(k).null_count:
                    raise ValueError(f"a row has a value that isn't on the axis {d}")
                index.append(b.column(k).to_numpy().astype(np.int64))
            number = np.ravel_multi_index([i // c for i, c in zip(index, self.chunks)], grid) if b.num_rows else np.zeros(0, np.int64)
            cuts = np.flatnonzero(np.diff(number)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                if number[lo] != now:
                    if now is not None:
                        flush()
                    now, done = int(number[lo]), done + 1
                    arrays = {n: np.full(self.chunks, self._fill(n), k) for n, k in self.kinds.items()}
                    seen = np.zeros(self.chunks, bool)
                at = tuple(i[lo:hi] % c for i, c in zip(index, self.chunks))
                flat = np.ravel_multi_index(at, self.chunks)
                if seen.reshape(-1)[flat].any() or len(np.unique(flat)) < len(flat):
                    raise ValueError("two rows are the same cell")
                seen[at] = True
                for k, (name, kind) in enumerate(self.kinds.items(), len(self.dims)):
                    column = b.column(k).slice(lo, hi - lo)
                    arrays[name][at] = column.fill_null(self._fill(name)).to_numpy(zero_copy_only=False).astype(kind)
        if now is not None:
            flush()
        return Written(done)

    def _array(self, shape, chunks, kind, fill) -> dict:
        fill = "NaN" if isinstance(fill, float) and math.isnan(fill) else fill
        return {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": kind.str, "order": "C", "filters": None, "fill_value": fill, "compressor": None if self.pack == "none" else {"id": self.pack, "level": 4 if self.pack != "zstd" else 3}}

    def commit(self, messages) -> None:
        fs, new = placed(self.new)
        _, path = placed(self.path)
        meta = {}
        for name, kind in self.kinds.items():
            fill = self._fill(name)
            meta[f"{name}/.zarray"] = self._array(self.shape, self.chunks, kind, fill)
            meta[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": self.dims, **self.attrs.get(name, {}), **({} if kind.kind == "f" else {"_FillValue": fill})}
        old = None if self.overwrite or not _there(fs, path) else Zarr(self.path)
        if old is None:
            meta |= {".zgroup": {"zarr_format": 2}, ".zattrs": self.attrs.get("", {})}
            for d, a in self.axes.items():
                values = np.array(a["values"], a["kind"])
                meta[f"{d}/.zarray"] = self._array([len(values)], [max(1, len(values))], values.dtype, None)
                meta[f"{d}/.zattrs"] = {"_ARRAY_DIMENSIONS": [d], **a["attrs"]}
                fs.create_dir(f"{new}/{d}")
                data = values.tobytes()
                self._put(fs, f"{new}/{d}/0", _PACK[self.pack](data) if self.pack != "none" else data)
        for key, m in meta.items():
            fs.create_dir(f"{new}/{key}".rpartition("/")[0])
            self._put(fs, f"{new}/{key}", _json(m))
        aside = f"{path}.old-{uuid.uuid4().hex}"
        if old is None:
            self._put(fs, f"{new}/.zmetadata", _json({"zarr_consolidated_format": 1, "metadata": meta}))
            if _there(fs, path):
                fs.move(path, aside)
            fs.move(new, path)
        else:
            kept = {}
            for v in old.variables.values():
                kept[f"{v.name}/.zarray"], kept[f"{v.name}/.zattrs"] = v.where, {"_ARRAY_DIMENSIONS": list(v.dims), **v.attrs}
            fs.create_dir(aside)
            for name in self.kinds:
                if _there(fs, f"{path}/{name}"):
                    fs.move(f"{path}/{name}", f"{aside}/{name}")
                fs.move(f"{new}/{name}", f"{path}/{name}")
            group = {".zgroup": {"zarr_format": 2}, ".zattrs": json.loads(_read(fs, f"{path}/.zattrs")) if _there(fs, f"{path}/.zattrs") else {}}
            self._put(fs, f"{path}/.zmetadata", _json({"zarr_consolidated_format": 1, "metadata": group | kept | meta}))
            fs.delete_dir(new)
        if _there(fs, aside):
            fs.delete_dir(aside)

    def abort(self, messages) -> None:
        fs, new = placed(self.new)
        if _there(fs, new):
            fs.delete_dir(new)


class CubeSource(DataSource):
    """The data source "cube"."""

    @classmethod
    def name(cls) -> str:
        return "cube"

    def _cube(self) -> Cube:
        return Cube(self.options["path"], self.options.get("variables"))

    def schema(self) -> T.StructType:
        return self._cube().schema()

    def reader(self, schema: T.StructType) -> CubeReader:
        return (PushedReader if self.options.get("pushdown", "false").lower() == "true" else CubeReader)(self._cube(), dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> CubeWriter:
        return CubeWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("cube") known to the session, and let filters reach it where they are asked for."""
    spark.dataSource.register(CubeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_cube(spark: SparkSession, path: str, *variables: str, **within: tuple) -> DataFrame:
    """The cells of a cube; variables: those that are read (all of the most dimensions if none are named); within: the least and the largest value of dimensions, None for no bound."""
    register(spark)
    reader = spark.read.format("cube")
    if variables:
        reader = reader.option("variables", ",".join(variables))
    for name, ends in within.items():
        for side, value in zip(("from", "to"), ends):
            if value is not None:
                reader = reader.option(f"{side}.{name}", str(value))
    return reader.load(path)


def _axis(values: list) -> dict:
    """How an axis is stored: values, type, attributes."""
    if values and isinstance(values[0], datetime.datetime):
        return {"values": np.array(values, "M8[us]").astype(np.int64).tolist(), "kind": "<i8", "attrs": {"units": "microseconds since 1970-01-01", "calendar": "proleptic_gregorian"}}
    if values and isinstance(values[0], datetime.date):
        return {"values": np.array(values, "M8[D]").astype(np.int64).tolist(), "kind": "<i8", "attrs": {"units": "days since 1970-01-01", "calendar": "proleptic_gregorian"}}
    return {"values": values, "kind": "<f8" if values and isinstance(values[0], float) else "<i8", "attrs": {}}


def write_cube(
    df: DataFrame, path: str, dims: list[str], chunks: list[int], append: bool = False, compression: str = "zlib", descending: tuple[str, ...] = (), attrs: dict | None = None,
) -> None:
    """Write df (columns dims, and the others as variables) as a Zarr store.

    append: add the variables to a store with the same axes, or put them in
    place of those of their names; otherwise what is there is replaced. Axes are
    the values that occur, ascending, or descending for those named. Rows are
    dealt by chunk, so that a task builds whole chunks, one at a time, and holds
    one chunk of each variable. Cells without a row, and nulls, are unknown
    (NaN, or the least whole number). Two rows of one cell, values that aren't on
    the axes of a store that is appended to, and axes over AXIS_VALUES fail the job,
    and a job that fails changes nothing.
    """
    spark = df.sparkSession
    register(spark)
    fs, at = placed(path)
    known = Cube(path).axes if append and _there(fs, at) else {}
    axes, rows = {}, df
    for k, d in enumerate(dims):
        if d in known:
            values = known[d].tolist()
        else:
            values = [r[0] for r in df.select(d).where(F.col(d).isNotNull()).distinct().orderBy(F.desc(d) if d in descending else d).limit(AXIS_VALUES + 1).collect()]
            if len(values) > AXIS_VALUES:
                raise ValueError(f"the axis {d} has over {AXIS_VALUES} values")
        axes[d] = _axis(values)
        index = spark.createDataFrame([(x, i) for i, x in enumerate(values)], T.StructType([T.StructField(d, df.schema[d].dataType), T.StructField(f"_i{k}", T.IntegerType())]))
        rows = rows.join(index, d, "left")
    numbers = [F.floor(F.col(f"_i{k}") / min(c, max(1, len(axes[d]["values"])))) for k, (d, c) in enumerate(zip(dims, chunks))]
    rows = rows.repartition(*numbers).sortWithinPartitions(*numbers)
    out = rows.select(*[f"_i{k}" for k in range(len(dims))], *[c for c in df.columns if c not in dims])
    writer = out.write.format("cube").mode("append" if append else "overwrite").option("axes", json.dumps(axes)).option("chunks", json.dumps(chunks))
    writer.option("compression", compression).option("attrs", json.dumps(attrs or {})).save(path)
