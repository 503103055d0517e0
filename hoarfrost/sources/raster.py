"""TIFF rasters as cells, read and written by Spark tasks."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hoarfrost.operators.storage import forget, written

from .cube import placed

# Tags of the TIFF format and of its GDAL and GeoTIFF extensions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
#: GeoTIFF keys of the coordinate system: type of model, geographic, projected.
MODEL_KEY, GEOGRAPHIC_KEY, PROJECTED_KEY = 1024, 2048, 3072
KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 12: "d"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


@dataclass
class Raster:
    """bands: (band, row, column). west, north, cell: its upper left corner and cell size (0, 0, 1 if not given). nodata: the value that means none. names: of the bands. epsg: the code of its coordinate system, if given."""

    bands: np.ndarray
    west: float = 0.0
    north: float = 0.0
    cell: float = 1.0
    nodata: float | None = None
    names: list[str] = field(default_factory=list)
    epsg: int | None = None


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's variable-length codes of 9 to 12 bits, the high bits first; 256 clears the table and 257 ends."""
    out, table, last = [], [], b""
    value = bits = 0
    width = 9
    for byte in data:
        value, bits = (value << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = value >> bits & ((1 << width) - 1)
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


class Stored:
    """The bytes of an open file, of which only the slices that are asked for are read."""

    def __init__(self, file):
        self.file = file

    def __getitem__(self, part: slice) -> bytes:
        self.file.seek(part.start or 0)
        return self.file.read(part.stop - (part.start or 0))


def _tags(data: bytes | Stored) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[0:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        here = at + 2 + 12 * k
        tag, kind, n = struct.unpack(order + "HHI", data[here : here + 8])
        if kind in KINDS:
            size = struct.calcsize(order + KINDS[kind]) * n
            where = here + 8 if size <= 4 else struct.unpack(order + "I", data[here + 8 : here + 12])[0]
            tags[tag] = (data[where : where + n],) if kind == 2 else struct.unpack(order + KINDS[kind] * n, data[where : where + size])
    return order, tags


def _undone(raw: bytes, order: str, kind: str, size: int, shape: tuple[int, int, int], predictor: int) -> np.ndarray:
    """A block (row, column, sample) with its predictor taken back."""
    rows, width, samples = shape
    if predictor == 3:  # bytes of a row by significance, each the difference to the one before
        planes = np.frombuffer(raw, np.uint8, rows * width * samples * size).reshape(rows, -1, samples).cumsum(axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, size, width * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(f">f{size}").reshape(shape)
    values = np.frombuffer(raw, f"{order}{kind}{size}", rows * width * samples).reshape(shape)
    return values.cumsum(axis=1, dtype=values.dtype.newbyteorder("=")) if predictor == 2 else values


def decode(data: bytes | Stored, window: tuple[int, int, int, int] | None = None) -> Raster:
    """Bands in strips or tiles, together or apart; plain, LZW or deflated, with or without a predictor, of 8 to 64 bits; other forms are refused.

    Only blocks that meet the window (first row, last row, first and last
    column) are unpacked; the corner is then that of the window.
    """
    order, tags = _tags(data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, packing, samples = one(WIDTH, 0), one(HEIGHT, 0), one(COMPRESSION, PLAIN), one(SAMPLES, 1)
    unpack = {PLAIN: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}.get(packing)
    tiled = TILE_OFFSETS in tags
    if unpack is None or not tiled and OFFSETS not in tags or one(PREDICTOR, 1) not in (1, 2, 3) or one(BITS, 8) % 8:
        raise ValueError("this form of TIFF isn't read")
    high, wide = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS, height), height), width)
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
    across, down, apart = -(-width // wide), -(-height // high), one(PLANAR, 1) == 2
    a, b, c, d = window or (0, height - 1, 0, width - 1)
    a, b, c, d = max(0, a), min(b, height - 1), max(0, c), min(d, width - 1)
    kind, size = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)], one(BITS, 8) // 8
    out = np.zeros((samples, max(0, b - a + 1), max(0, d - c + 1)), f"{kind}{size}")
    for plane in range(samples if apart else 1):
        for r in range(a // high, b // high + 1):
            for q in range(c // wide, d // wide + 1):
                k = (plane * down + r) * across + q
                rows = high if tiled else min(high, height - r * high)
                block = _undone(unpack(data[offsets[k] : offsets[k] + counts[k]]), order, kind, size, (rows, wide, 1 if apart else samples), one(PREDICTOR, 1))
                top, left = max(a, r * high), max(c, q * wide)
                part = block[top - r * high : b + 1 - r * high, left - q * wide : d + 1 - q * wide]
                part = part[: height - top, : width - left].transpose(2, 0, 1)
                out[plane if apart else slice(None), top - a : top - a + part.shape[1], left - c : left - c + part.shape[2]] = part[0] if apart else part
    text = one(NODATA, b"").rstrip(b"\x00 ").decode() if NODATA in tags else ""
    tie, scale = tags.get(TIE_POINT, (0,) * 6), tags.get(PIXEL_SCALE, (1.0,))
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4) if keys[k + 1] == 0}
    found = re.findall(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)</Item>', one(METADATA, b"").decode("utf-8", "replace")) if METADATA in tags else []
    names = [dict(found).get(str(k), f"band_{k + 1}") for k in range(samples)]
    return Raster(out, float(tie[3]) + c * float(scale[0]), float(tie[4]) - a * float(scale[0]), float(scale[0]), float(text) if text else None, names, codes.get(PROJECTED_KEY, codes.get(GEOGRAPHIC_KEY)))


def _strip(values: np.ndarray, nodata: float | None) -> bytes:
    """Rows of a band, deflated, as little-endian 32-bit floats."""
    return zlib.compress(np.where(np.isnan(values), np.nan if nodata is None else nodata, values).astype("<f4").tobytes())


def encode(r: Raster) -> bytes:
    """A deflated little-endian 32-bit float TIFF with one strip a band, its bands' names and its coordinate system."""
    strips = [_strip(v, r.nodata) for v in r.bands]
    first, last = _around(r, r.bands.shape, r.bands.shape[1], [len(x) for x in strips])
    return first + b"".join(strips) + last


def _around(r: Raster, shape: tuple[int, int, int], rows: int, lengths: list[int]) -> tuple[bytes, bytes]:
    """What stands before and behind the strips (of so many rows; lengths in bytes, band after band) of a raster of a shape; r's bands aren't looked at."""
    n, height, width = shape
    at = np.cumsum([8, *lengths]).tolist()
    if at[-1] + 16 * len(lengths) > 4_000_000_000:
        raise ValueError("a TIFF is 4 GB at most")
    names = "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{x}</Item>' for k, x in enumerate(r.names))
    own = {
        WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [32] * n), COMPRESSION: (3, [DEFLATE]), PHOTOMETRIC: (3, [1]), OFFSETS: (4, at[:-1]), SAMPLES: (3, [n]), ROWS: (4, [rows]),
        COUNTS: (4, lengths), PLANAR: (3, [2]), FORMAT: (3, [3] * n), PIXEL_SCALE: (12, [r.cell, r.cell, 0.0]), TIE_POINT: (12, [0, 0, 0, r.west, r.north, 0]),
        NODATA: (2, (b"nan" if r.nodata is None else repr(float(r.nodata)).encode()) + b"\x00"),
    }
    if r.epsg:
        flat = 4000 <= r.epsg < 5000
        own[GEO_KEYS] = (3, [1, 1, 0, 2, MODEL_KEY, 0, 1, 2 if flat else 1, GEOGRAPHIC_KEY if flat else PROJECTED_KEY, 0, 1, r.epsg])
    if r.names:
        own[METADATA] = (2, f"<GDALMetadata>{names}</GDALMetadata>".encode() + b"\x00")
    directory, extra = b"", b""
    for tag, (kind, x) in sorted(own.items()):
        raw = x if kind == 2 else struct.pack("<" + KINDS[kind] * len(x), *x)
        if len(raw) > 4:
            extra += b"\x00" * (len(extra) % 2)
            raw, extra = struct.pack("<I", at[-1] + len(extra)), extra + raw
        directory += struct.pack("<HHI", tag, kind, len(x)) + raw.ljust(4, b"\x00")
    extra += b"\x00" * (len(extra) % 2)
    return b"II*\x00" + struct.pack("<I", at[-1] + len(extra)), extra + struct.pack("<H", len(own)) + directory + struct.pack("<I", 0)


CELLS = "layer string, row int, col int, value double"
#: Cells of a strip that is written, and of the blocks that a task reads.
STRIP_CELLS, PART_CELLS = 1 << 18, 1 << 20


def read_cells(spark: SparkSession, path: str, zero_fill: bool = False, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(layer, row, col, value) of the TIFFs of a path; layer is the file's name without .tif, and for one of several bands the band's name behind a dot.

    A task reads some blocks of a file. No-data cells are null (0 with
    zero_fill, for binary layers). window (first
    row, last row, first and last column): only blocks that meet it are
    unpacked. Rows and columns are those of the whole raster.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path)
    layer = F.regexp_extract("path", r"([^/]*)\.tif$", 1).alias("layer")

    def cells(layer: str, data: bytes | Stored, window: tuple[int, int, int, int] | None) -> Iterator[pd.DataFrame]:
        r = decode(data, window)
        first_row, first_col = (max(0, window[0]), max(0, window[2])) if window else (0, 0)
        for name, band in zip(r.names, r.bands):
            for row in range(0, band.shape[0], 256):  # some rows at a time
                v = band[row : row + 256].astype(float)
                if r.nodata is not None:
                    v[np.isclose(v, r.nodata)] = np.nan
                rows, cols = np.indices(v.shape)
                flat = v.ravel()
                yield pd.DataFrame({"layer": layer if len(r.bands) == 1 else f"{layer}.{name}", "row": (rows.ravel() + row + first_row).astype("int32"), "col": (cols.ravel() + first_col).astype("int32"), "value": np.nan_to_num(flat, nan=0.0) if zero_fill else flat})

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for layer, path in zip(pdf["layer"], pdf["path"]):
                fs, at = placed(path)
                with fs.open_input_file(at) as f:
                    tags = _tags(Stored(f))[1]
                high, wide = tags[HEIGHT][0], tags[WIDTH][0]
                block = tags[TILE_HEIGHT][0] if TILE_OFFSETS in tags else min(tags.get(ROWS, (high,))[0], high)
                a, b, c, d = window or (0, high - 1, 0, wide - 1)
                a, b = max(0, a), min(b, high - 1)
                step = max(1, PART_CELLS // max(1, block * wide)) * max(1, block)  # whole blocks
                starts = np.arange(a // step, max(a, b) // step + 1) * step
                yield pd.DataFrame({"layer": layer, "path": path, "a": np.maximum(a, starts), "b": np.minimum(b, starts + step - 1), "c": c, "d": d})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for layer, path, *part in pdf.itertuples(index=False):
                fs, at = placed(path)
                with fs.open_input_file(at) as f:
                    yield from cells(layer, Stored(f), tuple(part))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for layer, content in zip(pdf["layer"], pdf["content"]):
                yield from cells(layer, content, window)

    if re.match(r"/|file:/", path):
        out = files.select(layer, "path").mapInPandas(listed, "layer string, path string, a int, b int, c int, d int").repartition("path", "a").mapInPandas(read, CELLS)
    else:  # a store that only Spark may be able to read: whole files
        out = files.select(layer, "content").mapInPandas(whole, CELLS)
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(layer, height, width, west, north, cell, nodata, epsg, names) of the TIFFs of a path: what a raster is apart from its cells, of which one is unpacked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path).select(F.regexp_extract("path", r"([^/]*)\.tif$", 1).alias("layer"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for layer, content in zip(pdf["layer"], pdf["content"]):
                r, tags = decode(content, (0, 0, 0, 0)), _tags(content)[1]
                rows.append((layer, tags[HEIGHT][0], tags[WIDTH][0], r.west, r.north, r.cell, r.nodata, r.epsg, r.names))
            yield pd.DataFrame(rows, columns=["layer", "height", "width", "west", "north", "cell", "nodata", "epsg", "names"]).astype({"epsg": "Int32"})

    return files.mapInPandas(run, "layer string, height int, width int, west double, north double, cell double, nodata double, epsg int, names array<string>")


def to_rasters(cells: DataFrame, height: int, width: int, west: float = 0.0, north: float = 0.0, cell: float = 1.0, nodata: float | None = None, bands: list[str] | None = None, epsg: int | None = None) -> DataFrame:
    """(layer, content): a TIFF for every layer; a layer is as large as the grid, whatever the number of layers.

    With bands, cells also have a column band, and each layer is one raster of
    these bands, which carry their names; cells of other bands are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full((len(bands or [""]), height, width), np.nan)
        at = np.array([bands.index(b) if b in bands else -1 for b in pdf["band"]]) if bands else np.zeros(len(pdf), int)
        own = pdf[at >= 0]
        out[at[at >= 0], own["row"].to_numpy(), own["col"].to_numpy()] = own["value"].to_numpy(dtype=float)
        return pd.DataFrame({"layer": [pdf["layer"].iloc[0]], "content": [encode(Raster(out, west, north, cell, nodata, bands or [], epsg))]})

    return cells.groupBy("layer").applyInPandas(run, "layer string, content binary")


def save(rasters: DataFrame, folder: str) -> int:
    """Write rasters (layer, content) as files folder/layer.tif, from the tasks; how many. A file is there whole or not at all, whichever attempt of a task writes it."""
    fs, at = placed(folder)
    fs.create_dir(at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = placed(folder)
        for pdf in batches:
            for layer, content in zip(pdf["layer"], pdf["content"]):
                aside = f"{at}/.{layer}.{uuid.uuid4().hex}"
                with fs.open_output_stream(aside) as f:
                    f.write(bytes(content))
                fs.move(aside, f"{at}/{layer}.tif")
            yield pd.DataFrame({"n": [len(pdf)]})

    return rasters.select("layer", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_rasters(cells: DataFrame, folder: str, height: int, width: int, west: float = 0.0, north: float = 0.0, cell: float = 1.0, nodata: float | None = None, bands: list[str] | None = None, epsg: int | None = None) -> int:
    """What to_rasters() and save() write, in strips of rows: no task holds more than a strip, whatever the grid's size. How many files.

    Tasks make the strips, which are written once to the shared folder; then a
    layer's strips are put behind each other in a file, one at a time.
    """
    rows = min(height, max(1, STRIP_CELLS // max(1, width)))
    strips = -(-height // rows)
    band = F.array_position(F.array(*map(F.lit, bands)), F.col("band")).cast("int") - 1 if bands else F.lit(0)
    own = cells.select("layer", band.alias("band"), F.floor(F.col("row") / rows).cast("int").alias("strip"), "row", "col", F.col("value").cast("double").alias("value")).where("band >= 0")
    # Strips without a cell are made too.
    every = cells.select("layer").distinct().select("layer", F.explode(F.sequence(F.lit(0), F.lit(len(bands or [""]) - 1))).alias("band")).select("layer", "band", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"))

    def pack(key: tuple, own: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        layer, band, strip = key
        values = np.full((min(rows, height - strip * rows), width), np.nan)
        values[own["row"].to_numpy() - strip * rows, own["col"].to_numpy()] = own["value"].to_numpy(dtype=float)
        return pd.DataFrame({"layer": [layer], "band": [band], "strip": [strip], "data": [_strip(values, nodata)]})

    keys = ["layer", "band", "strip"]
    made = written(own.groupBy(keys).cogroup(every.groupBy(keys)).applyInPandas(pack, "layer string, band int, strip int, data binary").withColumn("size", F.length("data")), "strips")
    sizes = made.groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("band", "strip", "size"))).alias("sizes"))  # three numbers a strip
    heads = sizes.select("layer", F.lit(-1).alias("band"), F.lit(0).alias("strip"), F.lit(None).cast("binary").alias("data"), F.col("sizes.size").alias("sizes"))
    parts = heads.unionByName(made.select("layer", "band", "strip", "data", F.lit(None).cast("array<int>").alias("sizes"))).repartition("layer").sortWithinPartitions("layer", "band", "strip")
    fs, at = placed(folder)
    fs.create_dir(at)
    profile = Raster(np.zeros((0, 0, 0)), west, north, cell, nodata, bands or [], epsg)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = placed(folder)
        f, n, end, names = None, 0, b"", ()
        for b in batches:
            for layer, data, lengths in zip(*(b.column(c) for c in ("layer", "data", "sizes"))):
                if lengths.is_valid:  # a layer begins
                    if f:
                        f.write(end)
                        f.close()
                        fs.move(*names)
                    names, n = (f"{at}/.{layer.as_py()}.{uuid.uuid4().hex}", f"{at}/{layer.as_py()}.tif"), n + 1
                    begin, end = _around(profile, (len(bands or [""]), height, width), rows, lengths.as_py())
                    f = fs.open_output_stream(names[0])
                    f.write(begin)
                else:
                    f.write(data.as_buffer())
        if f:
            f.write(end)
            f.close()
            fs.move(*names)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    done = parts.mapInArrow(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    forget(made)
    return done


def wide(cells: DataFrame, layers: list[str]) -> DataFrame:
    """One row a cell with a column a layer: complete pixels are those without a null."""
    return cells.groupBy("row", "col").pivot("layer", layers).agg(F.first("value"))


def inside(low_row: int, high_row: int, low_col: int, high_col: int) -> Column:
    return F.col("row").between(low_row, high_row) & F.col("col").between(low_col, high_col)
