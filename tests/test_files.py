"""Rasters and writers, round trip."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoarfrost import sinks
from hoarfrost.operators import models
from hoarfrost.sources import raster


def test_tiff_round_trip():
    a = np.arange(24.0).reshape(2, 3, 4)
    a[0, 1, 2] = np.nan
    for nodata, epsg in ((None, None), (-9999.0, 32617), (-1.0, 4326)):
        r = raster.decode(raster.encode(raster.Raster(a, 100.0, 200.0, 30.0, nodata, ["week_01", "week_02"], epsg)))
        back = r.bands.astype(float)
        if nodata is not None:
            assert back[0, 1, 2] == nodata
            back[0, 1, 2] = np.nan
        assert np.array_equal(back, a, equal_nan=True) and (r.west, r.north, r.cell, r.names, r.epsg) == (100.0, 200.0, 30.0, ["week_01", "week_02"], epsg)
    with pytest.raises(ValueError):
        raster.decode(b"nothing like it")


def pack_lzw(data):
    """A plain encoder of TIFF's codes."""
    table, width, out = {bytes([k]): k for k in range(256)}, 9, "{:09b}".format(256)
    following, w = 258, b""
    for k in range(len(data)):
        c = data[k : k + 1]
        if w + c in table:
            w += c
            continue
        out += format(table[w], f"0{width}b")
        table[w + c] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4094:
            out += format(256, f"0{width}b")
            table, width, following = {bytes([k]): k for k in range(256)}, 9, 258
        w = c
    out += (format(table[w], f"0{width}b") if w else "")
    width = 9 if following + 1 < 512 else 10 if following + 1 < 1024 else 11 if following + 1 < 2048 else 12
    out += format(257, f"0{width}b")
    out += "0" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big")


def made_tiff(values, order, packing, predictor, tile, apart):
    """A TIFF of values (band, row, column), block by block."""
    n, height, width = values.shape
    size, kind = values.dtype.itemsize, {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    high, wide = tile or (2, width)
    blocks = []
    for plane in range(n) if apart else [slice(None)]:
        for r in range(0, height, high):
            for c in range(0, width, wide):
                part = values[plane if not apart else [plane], r : r + high, c : c + wide].transpose(1, 2, 0)
                if tile:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
                if predictor == 3:
                    rows = []
                    for row in part.reshape(part.shape[0], -1):
                        planes = np.frombuffer(row.astype(row.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(-1, size).T.ravel()
                        s = part.shape[2]
                        rows.append(np.concatenate([planes[:s], planes[s:] - planes[:-s]]).astype(np.uint8).tobytes())
                    raw = b"".join(rows)
                blocks.append({1: bytes, 5: pack_lzw, 8: zlib.compress}[packing](raw))
    tags = {256: [width], 257: [height], 258: [8 * size] * n, 259: [packing], 277: [n], 284: [2 if apart else 1], 317: [predictor], 339: [kind] * n}
    at = np.cumsum([8, *map(len, blocks)]).tolist()
    tags |= {322: [wide], 323: [high], 324: at[:-1], 325: list(map(len, blocks))} if tile else {273: at[:-1], 278: [high], 279: list(map(len, blocks))}
    extra, entries = b"", b""
    for tag, x in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(x)}I", *x)
        if len(raw) > 4:
            raw, extra = struct.pack(f"{order}I", at[-1] + len(extra)), extra + raw
        entries += struct.pack(f"{order}HHI", tag, 4, len(x)) + raw
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at[-1] + len(extra))
    return head + b"".join(blocks) + extra + struct.pack(f"{order}H", len(tags)) + entries + b"\0" * 4


@pytest.mark.parametrize("packing", [1, 5, 8])
@pytest.mark.parametrize("tile", [None, (16, 16), (3, 5)])
def test_forms_of_tiff(packing, tile):
    rng = np.random.default_rng(packing)
    for kind, predictor in (("u1", 1), ("i2", 2), ("u4", 2), ("f4", 1), ("f4", 3), ("f8", 3)):
        for apart in (False, True):
            for order in "<>":
                values = (rng.normal(size=(3, 21, 37)) * 100 + 128).clip(0, 255).astype(kind)
                data = made_tiff(values, order, packing, predictor, tile, apart)
                assert np.array_equal(raster.decode(data).bands, values), (kind, predictor, apart, order)
                r = raster.decode(data, (5, 17, 11, 30))
                assert np.array_equal(r.bands, values[:, 5:18, 11:31]) and (r.west, r.north) == (11.0, -5.0)
                assert raster.decode(data, (30, 40, 0, 3)).bands.size == 0


def test_long_codes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 30_000).astype(np.uint8).tobytes() + b"abc" * 9000
    assert raster.unpack_lzw(pack_lzw(data)) == data and raster.unpack_lzw(b"") == b""


def test_windows_unpack_only_their_blocks(monkeypatch):
    values = np.arange(64.0 * 64).reshape(1, 64, 64).astype("f4")
    data, seen = made_tiff(values, "<", 8, 1, (16, 16), False), []
    real = zlib.decompress
    monkeypatch.setattr(raster.zlib, "decompress", lambda x: seen.append(1) or real(x))
    raster.decode(data, (17, 20, 30, 33))
    assert len(seen) == 2


def test_cells(spark, tmp_path):
    a = np.arange(20.0).reshape(4, 5)
    for name, x in (("elev", a), ("mask", np.where(a > 10, 1.0, np.nan))):
        (tmp_path / f"{name}.tif").write_bytes(raster.encode(raster.Raster(x[None], nodata=-9999.0)))
    cells = raster.read_cells(spark, str(tmp_path))
    got = {(r.layer, r.row, r.col): r.value for r in cells.collect()}
    assert len(got) == 40 and got["elev", 3, 4] == 19.0 and got["mask", 0, 0] is None
    part = raster.read_cells(spark, str(tmp_path), zero_fill=True, window=(1, 2, 3, 4)).where("layer = 'mask'").collect()
    assert sorted((r.row, r.col, r.value) for r in part) == [(1, 3, 0.0), (1, 4, 0.0), (2, 3, 1.0), (2, 4, 1.0)]
    assert cells.where(raster.inside(0, 0, 0, 1)).count() == 4
    assert raster.wide(cells, ["elev", "mask"]).dropna().count() == 9
    again = {r.layer: raster.decode(bytes(r.content)) for r in raster.to_rasters(cells, 4, 5, nodata=-1.0).collect()}
    assert np.array_equal(again["elev"].bands[0], a.astype("f4")) and again["mask"].bands[0, 0, 0] == -1.0
    named = cells.selectExpr("'both' AS layer", "layer AS band", "row", "col", "value")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "both.tif").write_bytes(bytes(raster.to_rasters(named, 4, 5, 10.0, 20.0, 2.0, -1.0, ["mask", "elev"], 32617).first().content))
    both = {(r.layer, r.row, r.col): r.value for r in raster.read_cells(spark, str(tmp_path / "more")).collect()}
    assert both == {(f"both.{k[0]}", *k[1:]): x for k, x in got.items()}
    one = raster.read_profiles(spark, str(tmp_path / "more")).first()
    assert tuple(one) == ("both", 4, 5, 10.0, 20.0, 2.0, -1.0, 32617, ["mask", "elev"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 2, 0.25), (0, 1, 1, None)], "row int, col int, week_num int, frost_prob double")
    base = str(tmp_path)
    sinks.weekly_maps(df, f"{base}/maps", [1, 2])
    assert spark.read.parquet(f"{base}/maps/by_week").count() == 3 and sorted(os.listdir(f"{base}/maps/by_week"))[-1] == "week_num=2"
    wide = {(r.row, r.col): (r.week_01, r.week_02) for r in spark.read.parquet(f"{base}/maps/wide").collect()}
    assert wide == {(0, 0): (0.5, 0.25), (0, 1): (None, None)}
    sinks.csv(df, f"{base}/csv", {"frost_prob": 3})
    assert sorted(r.frost_prob or "" for r in spark.read.option("header", True).csv(f"{base}/csv").collect()) == ["", "0.250", "0.500"]
    sinks.record(spark, {"n": 3, "scores": [0.5, 0.25], "importance": {"a": 1.0}}, f"{base}/meta")
    text = [open(f"{base}/meta/{f}").read() for f in os.listdir(f"{base}/meta") if f.endswith(".json")]
    assert json.loads(text[0]) == {"n": 3, "scores": [0.5, 0.25], "importance": {"a": 1.0}}
    sinks.append(df, f"{base}/t")
    sinks.append(df, f"{base}/t")
    assert spark.read.parquet(f"{base}/t").count() == 6
    sinks.table(df, f"{base}/z", rows_a_file=1)
    rows = spark.createDataFrame([(float(i % 7), float(i)) for i in range(60)], "a double, y double")
    m = models.fit(rows, models.forest(["a"], "y", trees=2, depth=3, leaf=1))
    sinks.model(m, f"{base}/model")
    want = sorted((r.a, r.predicted) for r in m.transform(rows).collect())
    assert sorted((r.a, r.predicted) for r in sinks.load_model(spark, f"{base}/model").transform(rows).collect()) == want


def test_rasters_are_written_and_read_in_strips(spark, tmp_path, monkeypatch):
    """As to_rasters() makes them, with strips that have no cell; read in parts of a file."""
    monkeypatch.setattr(raster, "STRIP_CELLS", 12)
    monkeypatch.setattr(raster, "PART_CELLS", 20)
    rows = [(layer, band, r, c, float(r * 10 + c) if (r + c) % 3 else None) for layer in ("a", "b") for band in ("one", "two", "no") for r in (0, 1, 2, 9, 10) for c in range(4) if (layer, r) != ("b", 9)]
    cells = spark.createDataFrame(rows, "layer string, band string, row int, col int, value double")
    more = dict(west=5.0, north=9.0, cell=2.0, nodata=-1.0, bands=["one", "two"], epsg=32617)
    assert raster.write_rasters(cells, str(tmp_path), 11, 4, **more) == 2
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["a.tif", "b.tif"]
    want = {r.layer: raster.decode(bytes(r.content)) for r in raster.to_rasters(cells, 11, 4, **more).collect()}
    for layer, w in want.items():
        got = raster.decode((tmp_path / f"{layer}.tif").read_bytes())
        assert np.array_equal(got.bands, w.bands) and (got.west, got.north, got.cell, got.nodata, got.names, got.epsg) == (w.west, w.north, w.cell, w.nodata, w.names, w.epsg)
    for window in (None, (2, 9, 1, 2), (10, 99, 0, 3)):
        a, b, c, d = window or (0, 10, 0, 3)
        read = {(r.layer, r.row, r.col): r.value for r in raster.read_cells(spark, str(tmp_path), window=window).collect()}
        assert read == {(f"{layer}.{n}", r, q): None if v == -1 else float(v) for layer, w in want.items() for n, band in zip(w.names, w.bands) for (r, q), v in np.ndenumerate(band) if a <= r <= b and c <= q <= d}
