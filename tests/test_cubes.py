"""Cubes: what is written is read again, chunks that aren't asked for aren't opened, failed jobs change nothing, files of other writers."""

import datetime
import json
import math
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoarfrost.operators.grid import Lattice
from hoarfrost.sources import cube

DIMS, CHUNKS = ["time", "lat", "x"], [3, 4, 4]


def cells(spark, n=10):
    i = F.col("id")
    return spark.range(n * 42).select(
        F.expr("date_add(date'2020-01-01', cast(id div 42 as int))").alias("time"), (F.expr("(id div 6) % 7") * 0.5 + 30).alias("lat"), (i % 6).alias("x"),
        F.when(i % 5 != 0, i * 1.5).cast("float").alias("t"), F.when(i % 7 != 0, i).cast("int").alias("n"),
    )


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_round_trip(spark, tmp_path):
    df, path = cells(spark), f"{tmp_path}/a.zarr"
    for compression in ("zlib", "zstd", "gzip", "none"):
        cube.write_cube(df, path, DIMS, CHUNKS, compression=compression, descending=("lat",))
        assert same(cube.read_cube(spark, path), df)
    meta = json.load(open(f"{path}/t/.zarray"))
    assert meta["chunks"] == CHUNKS and meta["fill_value"] == "NaN" and json.load(open(f"{path}/t/.zattrs"))["_ARRAY_DIMENSIONS"] == DIMS
    assert cube.Cube(path).axes["lat"].tolist() == [33.0 - k / 2 for k in range(7)]
    holes = df.where("id % 3 <> 1" if "id" in df.columns else "x <> 2 OR lat < 31")  # cells without a row are unknown
    cube.write_cube(holes.withColumn("time", F.col("time").cast("timestamp_ntz")), path, DIMS, CHUNKS)
    back = cube.read_cube(spark, path)
    assert same(back.where("t IS NOT NULL OR n IS NOT NULL"), holes.withColumn("time", F.col("time").cast("timestamp_ntz")).where("t IS NOT NULL OR n IS NOT NULL")) and back.count() == 420
    assert cube.read_cube(spark, path, "n").columns == [*DIMS, "n"] and os.listdir(tmp_path) == ["a.zarr"]


def test_only_chunks_that_are_met_are_opened(spark, tmp_path):
    path = f"{tmp_path}/a.zarr"
    df = cells(spark)
    cube.write_cube(df, path, DIMS, CHUNKS)
    for var in ("t", "n"):
        for name in os.listdir(f"{path}/{var}"):
            if not name.startswith(".") and not name.startswith("1.0."):
                open(f"{path}/{var}/{name}", "wb").write(b"broken")
    day, want = "DATE '2020-01-05'", df.where("time = DATE '2020-01-05' AND lat <= 31")
    pushed = lambda: spark.read.format("cube").option("pushdown", "true").load(path)
    for got in (
        cube.read_cube(spark, path, time=("2020-01-05", "2020-01-05"), lat=(None, 31)), pushed().where(f"time = {day} AND lat <= 31"), pushed().where(f"time IN ({day}) AND lat <= 31 AND x >= 0"),
    ):
        assert got.rdd.getNumPartitions() == 2 and same(got, want)
    both = pushed().where(f"time = {day} AND lat <= 31 AND x < 2").unionByName(pushed().where(f"time = {day} AND lat <= 31 AND x > 3"))
    assert same(both, want.where("x < 2 OR x > 3"))
    assert cube.read_cube(spark, path, time=("1999-01-01", "1999-12-31")).count() == 0
    with pytest.raises(Exception, match="broken|decompress|Error"):
        cube.read_cube(spark, path).collect()
    with pytest.raises(Exception, match="no dimension"):
        cube.read_cube(spark, path, y=(1, 2)).collect()


def test_append_by_variable(spark, tmp_path):
    path, df = f"{tmp_path}/a.zarr", cells(spark)
    cube.write_cube(df.drop("n"), path, DIMS, CHUNKS, append=True)  # nothing there yet
    cube.write_cube(df.drop("t"), path, DIMS, [5, 7, 6], append=True)
    cube.write_cube(df.select(*DIMS, (F.col("t") * 2).alias("t")), path, DIMS, CHUNKS, append=True)
    assert same(cube.read_cube(spark, path), df.withColumn("t", F.col("t") * 2)) and os.listdir(tmp_path) == ["a.zarr"]
    with pytest.raises(Exception, match="isn't on the axis"):
        cube.write_cube(cells(spark, 11).select(*DIMS, F.lit(1).alias("u")), path, DIMS, CHUNKS, append=True)


@pytest.mark.parametrize("append", [False, True])
def test_a_failed_job_leaves_the_old_store(spark, tmp_path, append):
    """A task dies after others have written their chunks."""
    path, df = f"{tmp_path}/a.zarr", cells(spark)
    cube.write_cube(df, path, DIMS, CHUNKS)

    @F.udf("float")
    def dies(i):
        if i == 400:
            os._exit(1)
        return 0.0

    fails = df.select(*DIMS, "n").repartition(4).withColumn("t", dies(F.coalesce("n", F.lit(-1)))).select(*DIMS, "t")
    for bad, why in ((fails, "crash|exit|EOF|Worker"), (df.unionByName(df.limit(1)), "same cell")):
        with pytest.raises(Exception, match=why):
            cube.write_cube(bad, path, DIMS, CHUNKS, append=append)
        assert same(cube.read_cube(spark, path), df) and os.listdir(tmp_path) == ["a.zarr"]


def test_a_store_of_another_writer(spark, tmp_path):
    """No consolidated metadata, slashes between chunk numbers, column order, packed values, missing chunks, other units of time."""
    def put(name, data, meta, attrs):
        os.makedirs(f"{tmp_path}/z/{name}", exist_ok=True)
        json.dump({"zarr_format": 2, "filters": None, "compressor": None, "order": "C", "fill_value": None} | meta, open(f"{tmp_path}/z/{name}/.zarray", "w"))
        json.dump(attrs, open(f"{tmp_path}/z/{name}/.zattrs", "w"))
        for key, x in data.items():
            os.makedirs(os.path.dirname(f"{tmp_path}/z/{name}/{key}"), exist_ok=True)
            open(f"{tmp_path}/z/{name}/{key}", "wb").write(x)

    values = np.arange(12).reshape(4, 3)
    chunk = np.full((3, 2), -9, ">i2")
    chunk[:1, :] = values[3:, :2]
    put("v", {"1/0": zlib.compress(chunk.tobytes(order="F"))}, {"shape": [4, 3], "chunks": [3, 2], "dtype": ">i2", "order": "F", "fill_value": -9, "compressor": {"id": "zlib"}, "dimension_separator": "/"}, {"_ARRAY_DIMENSIONS": ["time", "lon"], "scale_factor": 0.5, "add_offset": 10, "_FillValue": -9})
    put("time", {"0": np.array([0, 6, 12, 18], "<i4").tobytes()}, {"shape": [4], "chunks": [4], "dtype": "<i4"}, {"_ARRAY_DIMENSIONS": ["time"], "units": "hours since 2000-02-28 12:00:00"})
    open(f"{tmp_path}/z/.zgroup", "w").write('{"zarr_format": 2}')
    got = {(r.time, r.lon): r.v for r in cube.read_cube(spark, f"file://{tmp_path}/z").collect()}
    times = [datetime.datetime(2000, 2, 28, 12) + datetime.timedelta(hours=6 * k) for k in range(4)]
    assert got == {(t, c): 10 + values[3, c] / 2 if t == times[3] and c < 2 else None for t in times for c in range(3)}
    put("w", {}, {"shape": [4, 3], "chunks": [3, 2], "dtype": "<f4", "compressor": {"id": "blosc"}}, {})
    with pytest.raises(Exception, match="can't be read"):
        cube.read_cube(spark, f"{tmp_path}/z")


def classic(version, records):
    """A classic file by the published grammar: time grows, lat doesn't; t is packed, p is plain, fixed isn't of the cube."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    wide = ">q" if version == 2 else ">i"
    att = lambda s, kind, data: name(s) + struct.pack(">ii", kind, len(data) if kind == 2 else 1) + data + b"\0" * (-len(data) % 4)
    listed = lambda tag, xs: struct.pack(">ii", tag if xs else 0, len(xs)) + b"".join(xs)
    lat = np.array([40.0, 41.0, 42.0], ">f4").tobytes()
    t = np.arange(records * 3).reshape(records, 3).astype(">i2")
    t[0, 1] = -1
    p = np.where(t == 4, np.nan, t * 0.25).astype(">f8")
    def header(begins):
        dims = listed(10, [name("time") + struct.pack(">i", 0), name("lat") + struct.pack(">i", 3)])
        var = lambda k, s, ids, atts, kind: name(s) + struct.pack(">i", len(ids)) + b"".join(struct.pack(">i", d) for d in ids) + listed(12, atts) + struct.pack(">ii", kind, 0) + struct.pack(wide, begins[k])
        vs = [var(0, "lat", [1], [], 5), var(1, "time", [0], [att("units", 2, b"days since 1999-12-31")], 4), var(2, "t", [0, 1], [att("missing_value", 3, struct.pack(">h", -1)), att("scale_factor", 5, struct.pack(">f", 0.5))], 3), var(3, "p", [0, 1], [], 6)]
        return b"CDF" + bytes([version]) + struct.pack(">i", records) + dims + listed(12, [att("title", 2, b"abc")]) + listed(11, vs)

    h = len(header([0] * 4))
    first = h + 12
    data = lat + b"".join(struct.pack(">i", 2 * k) + t[k].tobytes() + b"\0\0" + p[k].tobytes() for k in range(records))
    return header([h, first, first + 4, first + 12]) + data, t, p


@pytest.mark.parametrize("version", [1, 2])
def test_classic_netcdf(spark, tmp_path, monkeypatch, version):
    monkeypatch.setattr(cube, "SLAB_BYTES", 12)
    data, t, p = classic(version, 5)
    path = f"{tmp_path}/data.nc"
    open(path, "wb").write(data)
    day = lambda k: datetime.date(1999, 12, 31) + datetime.timedelta(days=2 * k)
    got = {(r.time, r.lat): (r.t, r.p) for r in cube.read_cube(spark, path).collect()}
    assert got == {(day(k), 40.0 + c): (None if t[k, c] == -1 else t[k, c] / 2, None if math.isnan(p[k, c]) else p[k, c]) for k in range(5) for c in range(3)}
    some = cube.read_cube(spark, path, "p", time=("2000-01-02", "2000-01-05"), lat=(41, None))
    assert sorted((r.time, r.lat) for r in some.collect()) == [(day(k), c) for k in (1, 2) for c in (41.0, 42.0)]
    with pytest.raises(Exception, match="no classic NetCDF"):
        open(path, "wb").write(b"\x89HDF")
        cube.read_cube(spark, path)


def test_lattice():
    a, b = Lattice.around([30.0, 30.5, 31.0], [-84, -83.75]), Lattice.around([31.0, 30.5, 30.0], [-83.75, -84])
    assert a == b == Lattice(31.25, -84.125, 0.5, 0.25, 3, 2) and a.affine() == (0.25, 0.0, -84.125, 0.0, -0.5, 31.25)
    one = Lattice.around([30.0], [5])
    assert (one.rows, one.dlat, one.north) == (1, 1 / 24, 30 + 1 / 48)
