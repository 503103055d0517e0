"""Queries on as-of, range and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoarfrost.functions import calendar as cal
from hoarfrost.operators import joins as ops

from . import views as v
from .registry import query
from .seasons import rounded

LATTICE = """v_lat AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 14 DAY)) AS DATE) AS center FROM (SELECT min(d) AS lo, max(d) AS hi FROM v_obs))"""
COMPOSITE = f"""{LATTICE}, v_comp AS (SELECT center, max(tmin) AS peak FROM v_obs JOIN v_lat ON d >= center - 7 AND d < center + 7 GROUP BY 1)"""


def centers(spark, sf_dir):
    span = v.obs(spark, sf_dir).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return span.select(F.explode(ops.lattice("lo", "hi", 14)).alias("center"))


def composite(spark, sf_dir):
    pairs = ops.within_windows(v.obs(spark, sf_dir).select("d", "tmin"), "d", centers(spark, sf_dir), "center")
    return pairs.groupBy("center").agg(F.max("tmin").alias("peak"))


@query(v.with_(v.OBS, v.LONG, COMPOSITE, body="""SELECT entity, d, nearest, round(peak, 6) AS peak FROM (SELECT entity, d, center AS nearest, peak, row_number() OVER (PARTITION BY entity, d ORDER BY abs(datediff('day', d, center)), center) AS rn
FROM v_obs CROSS JOIN v_comp) WHERE rn = 1"""))
def asof_nearest_date(spark, sf_dir):
    return rounded(ops.asof_nearest(v.obs(spark, sf_dir).select("entity", "d"), "d", composite(spark, sf_dir), "center"), "peak").select("entity", "d", "nearest", "peak")


@query(v.with_(v.LONG, "v_day AS (SELECT d AS day, round(min(value), 6) AS low FROM v_long GROUP BY 1)", body="""SELECT event_id, ts, day, low FROM (SELECT event_id, ts, CAST(CASE WHEN hour(ts) >= 12 THEN d + 1 ELSE d END AS DATE) AS day FROM v_long) JOIN v_day USING (day)"""))
def asof_exact_day_roll(spark, sf_dir):
    """Passes after noon UTC meet the next day's minimum; passes without such a day are dropped."""
    obs = v.long_obs(spark, sf_dir)
    days = obs.groupBy(F.col("d").alias("day")).agg(F.round(F.min("value"), 6).alias("low"))
    return obs.select("event_id", "ts", cal.climate_day(F.col("ts")).alias("day")).join(days, "day")


@query(v.with_(v.OBS, COMPOSITE, "v_week AS (SELECT weekofyear(center) AS w, quantile_cont(peak, 0.5) AS m FROM v_comp WHERE center < DATE '1995-09-01' OR center >= DATE '1997-01-01' GROUP BY 1)", body="""
SELECT entity, d, round(CASE WHEN year(d) >= 1999 THEN peak ELSE m END, 6) AS peak FROM
(SELECT entity, d, peak FROM (SELECT entity, d, peak, row_number() OVER (PARTITION BY entity, d ORDER BY abs(datediff('day', d, center)), center) AS rn FROM v_obs CROSS JOIN v_comp WHERE center < DATE '1995-09-01' OR center >= DATE '1997-01-01') WHERE rn = 1)
JOIN (SELECT dd, m FROM (SELECT dd, m, row_number() OVER (PARTITION BY dd ORDER BY abs(w - weekofyear(dd)), w) AS rn FROM (SELECT DISTINCT d AS dd FROM v_obs) CROSS JOIN v_week) WHERE rn = 1) ON d = dd"""))
def ndvi_asof_with_fallback(spark, sf_dir):
    part = composite(spark, sf_dir).where("center < date'1995-09-01' or center >= date'1997-01-01'")
    return rounded(ops.with_fallback(v.obs(spark, sf_dir).select("entity", "d"), "d", part, "center", "peak", 1999), "peak")


@query(v.with_(v.OBS, COMPOSITE, body="SELECT entity, center, round(max(tmin), 6) AS peak, count(*) AS n FROM v_obs JOIN v_lat ON d >= center - 7 AND d < center + 7 GROUP BY 1, 2"))
def window_max_composite(spark, sf_dir):
    pairs = ops.within_windows(v.obs(spark, sf_dir), "d", centers(spark, sf_dir), "center")
    return pairs.groupBy("entity", "center").agg(F.round(F.max("tmin"), 6).alias("peak"), F.count(F.lit(1)).alias("n"))


@query(v.with_(v.OBS, LATTICE, body="SELECT center, count(*) AS n_rows, count(DISTINCT entity) AS n_stations FROM v_obs JOIN v_lat ON d >= center - 10 AND d < center + 10 GROUP BY 1"))
def range_join_composite(spark, sf_dir):
    """Overlapping windows of 20 days every 14 days."""
    pairs = ops.within_windows(v.obs(spark, sf_dir), "d", centers(spark, sf_dir), "center", 10)
    return pairs.groupBy("center").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity").alias("n_stations"))


@query(v.with_(v.GRID, "v_pt AS (SELECT row * 100 + col AS id, row, col FROM v_grid WHERE z < 480.0::DOUBLE)", "v_valid AS (SELECT row AS r, col AS c FROM v_grid WHERE z > 513.0::DOUBLE)", body="""
SELECT p.id, p.row, p.col, b.r AS snap_row, b.c AS snap_col, b.d2 FROM v_pt p LEFT JOIN (SELECT id, r, c, d2 FROM (SELECT id, r, c, CAST((r - row) * (r - row) + (c - col) * (c - col) AS INTEGER) AS d2,
row_number() OVER (PARTITION BY id ORDER BY (r - row) * (r - row) + (c - col) * (c - col), r, c) AS rn FROM v_pt JOIN v_valid ON r BETWEEN row - 5 AND row + 5 AND c BETWEEN col - 5 AND col + 5) WHERE rn = 1) b ON p.id = b.id"""))
def spatial_snap(spark, sf_dir):
    cells = v.grid(spark, sf_dir)
    points = cells.where("z < 480.0").select((F.col("row") * 100 + F.col("col")).alias("id"), "row", "col")
    return ops.snap(points, cells.where("z > 513.0"))


STORED = [k / 20 for k in range(1, 21)]


@query(v.with_(v.OBS, body="""SELECT entity, d, CAST(t AS DOUBLE) / 20.0::DOUBLE AS threshold FROM (SELECT entity, d, t, row_number() OVER (PARTITION BY entity, d ORDER BY abs((dayofyear(d) / 366.0::DOUBLE) - t / 20.0::DOUBLE), t) AS rn FROM v_obs CROSS JOIN (SELECT range AS t FROM range(1, 21))) WHERE rn = 1"""))
def threshold_nearest(spark, sf_dir):
    return v.obs(spark, sf_dir).select("entity", "d", ops.nearest_value(F.dayofyear("d") / 366.0, STORED).alias("threshold"))


@query(v.with_(v.OBS, v.STATION, v.LONG, body="""SELECT o.entity, o.d, s.grp, round(o.tmin, 6) AS tmin, c.n_calls FROM v_obs o JOIN v_station s ON o.entity = s.station_id
LEFT JOIN (SELECT CAST(entity % 25 AS INTEGER) AS e, CAST(month(d) AS INTEGER) AS m, count(*) AS n_calls FROM v_long GROUP BY 1, 2) c ON c.e = o.entity AND c.m = month(o.d)"""))
def star_join(spark, sf_dir):
    """Observations with static columns of their station and a monthly fact."""
    calls = v.long_obs(spark, sf_dir).groupBy((F.col("entity") % 25).cast("int").alias("entity"), F.month("d").alias("m")).agg(F.count(F.lit(1)).alias("n_calls"))
    meta = v.station(spark, sf_dir).select(F.col("station_id").alias("entity"), "grp")
    obs = v.obs(spark, sf_dir).withColumn("m", F.month("d"))
    return rounded(obs.join(meta, "entity").join(calls, ["entity", "m"], "left").select("entity", "d", "grp", "tmin", "n_calls"), "tmin")
