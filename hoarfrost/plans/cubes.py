"""Queries over cubes: stores made from daily events by user, read back chunk by chunk."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hoarfrost.operators import grid as ops
from hoarfrost.operators.storage import shared_dir
from hoarfrost.sources.cube import Cube, read_cube, write_cube

from . import views as v
from .registry import query
from .seasons import rounded

#: Users on a lattice of ten columns; both coordinates are exact in binary.
WEATHER = """v_w AS (SELECT CAST(ts AS DATE) AS time, 33.0::DOUBLE + (user_id // 10) * 0.25::DOUBLE AS lat, -84.0::DOUBLE + (user_id % 10) * 0.25::DOUBLE AS lon, round(avg(value), 6) AS tmmn, max(value) AS pr FROM events GROUP BY 1, 2, 3)"""
CHUNKS = [10, 8, 5]


def weather(spark, sf_dir):
    """A day's mean and largest value of each user: time, lat, lon, tmmn, pr."""
    e = v.table(spark, sf_dir, "events")
    lat, lon = 33.0 + F.floor(F.col("user_id") / 10) * 0.25, -84.0 + (F.col("user_id") % 10) * 0.25
    return e.groupBy(F.col("ts").cast("date").alias("time"), lat.alias("lat"), lon.alias("lon")).agg(F.round(F.avg("value"), 6).alias("tmmn"), F.max("value").alias("pr"))


def stored(spark, sf_dir, **more) -> str:
    path = f"{shared_dir(spark)}/weather-{uuid.uuid4().hex}.zarr"
    write_cube(weather(spark, sf_dir), path, ["time", "lat", "lon"], CHUNKS, **more)
    return path


@query(v.with_(WEATHER, body="SELECT time, lat, lon, tmmn, pr FROM v_w WHERE time BETWEEN DATE '2024-01-06' AND DATE '2024-01-12' AND lat >= 34.5 AND lon < -82.5"))
def cube_box(spark, sf_dir):
    """Days and a box of a cube: bounds and filters choose the chunks; a day that isn't there gives no rows."""
    path = stored(spark, sf_dir, descending=("lat",))
    days = read_cube(spark, path, time=("2024-01-06", "2024-01-12"), lat=(34.5, None))
    none = spark.read.format("cube").option("pushdown", "true").load(path).where("time = DATE '1999-01-01'")
    return days.where("lon < -82.5 AND tmmn IS NOT NULL").unionByName(none)


@query(v.with_(WEATHER, body="SELECT time, count(*) AS n, round(max(pr), 6) AS pr, round(avg(tmmn + 1), 6) AS tmmn, round(max(pr - tmmn), 6) AS spread FROM v_w GROUP BY 1"))
def cube_variables(spark, sf_dir):
    """A cube whose variables are added, and put in place of others, one by one."""
    path = stored(spark, sf_dir)
    write_cube(weather(spark, sf_dir).withColumn("spread", F.col("pr") - F.col("tmmn")).drop("tmmn", "pr"), path, ["time", "lat", "lon"], CHUNKS, append=True)
    write_cube(read_cube(spark, path, "tmmn").withColumn("tmmn", F.col("tmmn") + 1), path, ["time", "lat", "lon"], CHUNKS, append=True, compression="zstd")
    days = read_cube(spark, path, "tmmn", "pr", "spread").groupBy("time")
    return rounded(days.agg(F.count("tmmn").alias("n"), F.max("pr").alias("pr"), F.avg("tmmn").alias("tmmn"), F.max("spread").alias("spread")), "pr", "tmmn", "spread")


STEP = 0.1
_SIDE = "[{{'i': CAST(floor({p}) AS INTEGER), 'w': 1 - ({p} - floor({p}))}}, {{'i': CAST(floor({p}) AS INTEGER) + 1, 'w': {p} - floor({p})}}]"


@query(v.with_(WEATHER, f"""v_n AS (SELECT max(lat) AS north, CAST(round((max(lat) - min(lat)) / 0.25) AS INTEGER) + 1 AS h, CAST(round((max(lon) - min(lon)) / 0.25) AS INTEGER) + 1 AS w, min(lon) AS west FROM v_w),
v_c AS (SELECT time, CAST(round((north - lat) / 0.25) AS INTEGER) AS r, CAST(round((lon - west) / 0.25) AS INTEGER) AS c, tmmn, pr FROM v_w CROSS JOIN v_n),
v_t AS (SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, (row + 0.5::DOUBLE) * 0.4::DOUBLE - 0.5::DOUBLE AS pr, (col + 0.5::DOUBLE) * 0.4::DOUBLE - 0.5::DOUBLE AS pc
FROM (SELECT unnest(range(CAST(floor(h * 2.5) AS INTEGER))) AS row, w FROM v_n) CROSS JOIN LATERAL (SELECT unnest(range(CAST(floor(w * 2.5) AS INTEGER))) AS col)),
v_b AS (SELECT s.time, p.row, p.col, sum(s.tmmn * wr * wc) / sum(wr * wc) AS tmmn FROM (SELECT row, col, unnest({_SIDE.format(p='pr')}) AS a, pc FROM v_t) p
CROSS JOIN LATERAL (SELECT unnest({_SIDE.format(p='p.pc')}) AS b) q CROSS JOIN LATERAL (SELECT a.i AS ri, a.w AS wr, b.i AS ci, b.w AS wc) x JOIN v_c s ON s.r = ri AND s.c = ci WHERE wr * wc <> 0 GROUP BY 1, 2, 3)""",
body="""SELECT d.time, t.row, t.col, round(b.tmmn, 6) AS tmmn, s.pr FROM (SELECT DISTINCT time FROM v_w) d CROSS JOIN v_t t LEFT JOIN v_b b ON b.time = d.time AND b.row = t.row AND b.col = t.col
LEFT JOIN v_c s ON s.time = d.time AND s.r = CAST(floor((t.row + 0.5::DOUBLE) * 0.4::DOUBLE) AS INTEGER) AND s.c = CAST(floor((t.col + 0.5::DOUBLE) * 0.4::DOUBLE) AS INTEGER)"""))  # fmt: skip
def cube_aligned(spark, sf_dir):
    """A cube whose latitudes run north, on a finer lattice from its own edges: bilinear temperatures, precipitation from the nearest cell."""
    path = stored(spark, sf_dir)
    axes = Cube(path).axes
    source = ops.Lattice.around(axes["lat"], axes["lon"])
    row, col = source.cell(F.col("lat"), F.col("lon"))
    cells = read_cube(spark, path).select("time", row.alias("row"), col.alias("col"), "tmmn", "pr")
    ratio = STEP / source.dlat, STEP / source.dlon
    targets = ops.lattice(spark, int(source.rows * source.dlat / STEP), int(source.cols * source.dlon / STEP))
    return rounded(ops.cube_resampled(targets, cells, "time", {"tmmn": "bilinear", "pr": "nearest"}, *ratio), "tmmn")
