"""Queries on ordered scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoarfrost.functions import calendar as cal
from hoarfrost.operators import series as ops

from . import views as v
from .registry import query
from .seasons import rounded

EVENTS = v.LONG


@query(v.with_(v.OBS, body="SELECT entity, d, round(tmin, 6) AS tmin, round(lag(tmin) OVER (PARTITION BY entity ORDER BY d), 6) AS tmin_prev FROM v_obs WHERE month(d) NOT IN (6, 7, 8)"))
def lag_prev_day(spark, sf_dir):
    obs = v.obs(spark, sf_dir).where(F.month("d").isin(*cal.FROST_MONTHS)).select("entity", "d", "tmin")
    return rounded(ops.lagged(obs, "entity", "d", ["tmin"]), "tmin", "tmin_prev")


@query(v.with_(v.LONG, body="SELECT entity, d, round(max(value) - min(value), 6) AS diurnal_range, round(max(value) - 273.15::DOUBLE, 6) AS high_c FROM v_long GROUP BY 1, 2"))
def diurnal_range(spark, sf_dir):
    return v.long_obs(spark, sf_dir).groupBy("entity", "d").agg(F.round(F.max("value") - F.min("value"), 6).alias("diurnal_range"), F.round(F.max("value") - 273.15, 6).alias("high_c"))


@query(v.with_(v.OBS, "v_gap AS (SELECT entity, CAST(datediff('day', DATE '1995-01-01', d) AS INTEGER) AS i, CASE WHEN n = 1 AND day(d) % 3 <> 0 THEN NULL ELSE tmin END AS v FROM v_obs)",
"v_n AS (SELECT *, last(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS x0, last(v IGNORE NULLS) OVER b AS y0, first(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS x1, first(v IGNORE NULLS) OVER a AS y1, count(v) OVER (PARTITION BY entity) AS n FROM v_gap WINDOW b AS (PARTITION BY entity ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
body="SELECT entity, i, round(v, 6) AS v, round(CASE WHEN n >= 2 THEN coalesce(v, y0 + (y1 - y0) * (i - x0) / nullif(x1 - x0, 0)::DOUBLE, y0, y1) ELSE v END, 6) AS filled FROM v_n"))
def gap_fill_linear(spark, sf_dir):
    gaps = v.obs(spark, sf_dir).select("entity", F.datediff("d", F.lit("1995-01-01").cast("date")).alias("i"), F.when((F.col("n") == 1) & (F.dayofmonth("d") % 3 != 0), None).otherwise(F.col("tmin")).alias("v"))
    return rounded(ops.gap_filled(gaps, "entity", "i", "v"), "v", "filled")


@query(v.with_(v.LONG, body="SELECT entity, event_id, ts, element, value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS rn FROM v_long) WHERE rn = 1"))
def dedup_keep_last(spark, sf_dir):
    return ops.newest(v.long_obs(spark, sf_dir).select("entity", "event_id", "ts", "element", "value"), "entity", "ts", "event_id")


@query(v.with_(v.LONG, "v_new AS (SELECT entity, max(value) AS value, 'new' AS origin FROM v_long WHERE d >= DATE '2024-01-20' GROUP BY 1)", "v_old AS (SELECT entity, max(value) AS value, 'old' AS origin FROM v_long WHERE d < DATE '2024-01-10' GROUP BY 1)",
    body="SELECT * FROM v_new UNION ALL SELECT * FROM v_old WHERE entity NOT IN (SELECT entity FROM v_new)"))
def upsert_inventory(spark, sf_dir):
    obs = v.long_obs(spark, sf_dir)
    part = lambda cond, name: obs.where(cond).groupBy("entity").agg(F.max("value").alias("value")).withColumn("origin", F.lit(name))
    return ops.upserted(part("d < date'2024-01-10'", "old"), part("d >= date'2024-01-20'", "new"), "entity")


@query(v.with_(v.LONG, body="SELECT event_id, entity, d FROM v_long WHERE d >= DATE '2024-01-15' AND entity NOT IN (SELECT entity FROM v_long WHERE d < DATE '2024-01-03' AND value > 0)"))
def incremental_anti_join(spark, sf_dir):
    obs = v.long_obs(spark, sf_dir).select("event_id", "entity", "d", "value")
    known = obs.where("d < date'2024-01-03' and value > 0").select("entity").distinct()
    return obs.where("d >= date'2024-01-15'").join(known, "entity", "left_anti").select("event_id", "entity", "d")


@query(v.with_(v.LONG, body="SELECT entity, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS i FROM v_long) WHERE (i - 1) % 5 = 0"))
def every_nth_thinning(spark, sf_dir):
    return ops.every_nth(v.long_obs(spark, sf_dir).select("entity", "event_id", "ts"), "entity", ["ts", "event_id"], 5)


@query(v.with_(v.LONG, body="SELECT entity, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY entity) AS n FROM v_long) WHERE i = floor(n / 2.0) + 1"))
def median_index_pick(spark, sf_dir):
    return ops.median_row(v.long_obs(spark, sf_dir).select("entity", "event_id", "ts"), "entity", ["ts", "event_id"])


HOURS = [0.5 + 0.25 * k for k in range(18)]


@query(v.with_(v.OBS, body="""SELECT entity, d, round(best, 6) AS predicted, hours FROM (SELECT entity, d, tmin + (sin(h) * 2.0::DOUBLE - h * 0.1::DOUBLE) AS best, h AS hours, row_number() OVER (PARTITION BY entity, d ORDER BY round(tmin + (sin(h) * 2.0::DOUBLE - h * 0.1::DOUBLE), 9), h) AS rn
FROM v_obs CROSS JOIN (SELECT 0.5::DOUBLE + 0.25::DOUBLE * range AS h FROM range(18))) WHERE rn = 1"""))
def sweep_argmin(spark, sf_dir):
    """The coldest of 18 hours before sunrise by a residual model, the smallest hour of equal ones; candidates stay in the row."""
    guess = lambda h: F.struct(F.round(F.col("tmin") + (F.sin(h) * 2.0 - h * 0.1), 9).alias("t"), h.alias("h"))
    best = F.array_min(F.transform(F.array(*map(F.lit, HOURS)), guess))
    return v.obs(spark, sf_dir).withColumn("b", best).select("entity", "d", F.round("b.t", 6).alias("predicted"), F.col("b.h").alias("hours"))
