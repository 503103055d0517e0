"""Queries on frost seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoarfrost.functions import calendar as cal
from hoarfrost.operators import season as ops

from . import views as v
from .registry import query

THRESHOLDS = [k / 20 for k in range(1, 21)]

FY = "CAST(CASE WHEN month(d) >= 9 THEN year(d) ELSE year(d) - 1 END AS INTEGER)"
FDOY = "(CASE WHEN dayofyear(d) >= 244 THEN dayofyear(d) - 244 ELSE dayofyear(d) + 121 END)"
FWEEK = f"CAST(CASE WHEN floor({FDOY} / 7.0) + 1 > 30 THEN 0 ELSE floor({FDOY} / 7.0) + 1 END AS INTEGER)"
SEASON = "month(d) IN (9, 10, 11, 12, 1, 2, 3, 4, 5)"
DATES = f"""v_dates AS (SELECT entity, {FY} AS frost_year, min(CASE WHEN tmin <= 0 AND month(d) >= 9 THEN {FDOY}::DOUBLE END) AS first_fall_frost_doy,
max(CASE WHEN tmin <= 0 AND month(d) <= 5 THEN {FDOY}::DOUBLE END) AS last_spring_frost_doy, count(*) AS n_days, round_even(count(*) / 273.0::DOUBLE, 3) AS completeness
FROM v_obs WHERE {SEASON} GROUP BY 1, 2 HAVING count(*) / 273.0::DOUBLE >= 0.2::DOUBLE)"""
COUNTS = f"""v_counts AS (SELECT entity, frost_year, week_num, CAST(sum(f) AS BIGINT) AS n_frost, count(*) AS n_days FROM
(SELECT entity, {FY} AS frost_year, {FWEEK} AS week_num, CASE WHEN tmin < 0 THEN 1 ELSE 0 END AS f FROM v_obs WHERE {SEASON}) WHERE week_num > 0 GROUP BY 1, 2, 3)"""
WEEKS = "v_weeks AS (SELECT CAST(range AS INTEGER) AS week_num FROM range(1, 40))"
SMOOTH = """v_smooth AS (SELECT entity, frost_year, week_num, coalesce(sum(n_frost) OVER w / nullif(sum(n_days) OVER w, 0)::DOUBLE, 0.0::DOUBLE) AS frost_prob
FROM (SELECT DISTINCT entity, frost_year FROM v_counts) CROSS JOIN v_weeks LEFT JOIN v_counts USING (entity, frost_year, week_num)
WINDOW w AS (PARTITION BY entity, frost_year ORDER BY week_num RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""
CLIM = "v_clim AS (SELECT entity, week_num, round(avg(frost_prob), 9) AS p FROM v_smooth GROUP BY 1, 2)"
CURVE = """v_s AS (SELECT entity, week_num, p, coalesce(product(1 - p) OVER (PARTITION BY entity ORDER BY week_num ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0::DOUBLE) AS survival,
max(p) OVER (PARTITION BY entity) AS top FROM v_clim),
v_p AS (SELECT *, min(CASE WHEN p = top THEN week_num END) OVER (PARTITION BY entity) AS peak FROM v_s),
v_curve AS (SELECT entity, week_num, p, survival, peak, sum(CASE WHEN week_num >= peak THEN p * survival ELSE 0.0::DOUBLE END) OVER (PARTITION BY entity ORDER BY week_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM v_p)"""
CROSS = """v_cross AS (SELECT entity, t / 20.0::DOUBLE AS threshold, min(CASE WHEN round(cum, 9) >= t / 20.0::DOUBLE THEN week_num END) AS step FROM v_curve CROSS JOIN (SELECT range AS t FROM range(1, 21)) GROUP BY 1, 2)"""


def smoothed(spark, sf_dir):
    return ops.weekly_probability(ops.weekly_counts(v.obs(spark, sf_dir), "entity"), cal.week_calendar(spark), "entity")


def climatology(spark, sf_dir):
    return smoothed(spark, sf_dir).groupBy("entity", "week_num").agg(F.round(F.avg("frost_prob"), 9).alias("p"))


def curve(spark, sf_dir):
    return ops.last_frost_curve(climatology(spark, sf_dir), "entity", "week_num", "p")


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(v.with_(v.OBS, DATES, body="SELECT * FROM v_dates"))
def frost_dates_by_station_year(spark, sf_dir):
    return ops.frost_dates(v.obs(spark, sf_dir), "entity", completeness=0.2)


@query(v.with_(v.OBS, f"v_m AS (SELECT entity, {FY} AS frost_year, avg(tmin) AS season_mean FROM v_obs WHERE {SEASON} GROUP BY 1, 2)",
    body="SELECT entity, frost_year, round(season_mean, 6) AS season_mean, round(season_mean - avg(season_mean) OVER (PARTITION BY entity), 6) AS anomaly FROM v_m"))
def seasonal_anomaly(spark, sf_dir):
    return rounded(ops.seasonal_anomaly(v.obs(spark, sf_dir), "entity"), "season_mean", "anomaly")


@query("""SELECT frost_year, CAST(w + 1 AS INTEGER) AS week_num, CAST(CASE WHEN 244 + 7 * w > 365 THEN 244 + 7 * w - 365 ELSE 244 + 7 * w END AS INTEGER) AS start_doy,
CAST(CASE WHEN 247 + 7 * w > 365 THEN 247 + 7 * w - 365 ELSE 247 + 7 * w END AS INTEGER) AS center_doy, CAST(CASE WHEN 250 + 7 * w > 365 THEN 250 + 7 * w - 365 ELSE 250 + 7 * w END AS INTEGER) AS end_doy,
strftime(f, '%b') || '-wk' || CAST(CAST(floor((day(f) - 1) / 7.0) + 1 AS INTEGER) AS VARCHAR) AS label
FROM (SELECT DISTINCT CAST(CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS frost_year FROM orders) CROSS JOIN (SELECT range AS w, DATE '2024-01-01' + CAST((CASE WHEN 244 + 7 * range > 365 THEN 244 + 7 * range - 365 ELSE 244 + 7 * range END) - 1 AS INTEGER) AS f FROM range(39))""")
def frost_week_calendar(spark, sf_dir):
    """The weeks of every season that has observations."""
    years = v.table(spark, sf_dir, "orders").select(cal.frost_year(F.col("o_orderdate")).alias("frost_year")).distinct()
    return years.crossJoin(F.broadcast(cal.week_calendar(spark)))  # 39 weeks


@query(v.with_(v.OBS, COUNTS, body="SELECT entity, frost_year, week_num, n_frost, n_days, round(n_frost / n_days::DOUBLE, 6) AS frost_prob FROM v_counts"))
def weekly_frost_prob_raw(spark, sf_dir):
    counts = ops.weekly_counts(v.obs(spark, sf_dir), "entity")
    return counts.withColumn("frost_prob", F.round(F.col("n_frost") / F.col("n_days").cast("double"), 6))


@query(v.with_(v.OBS, COUNTS, WEEKS, SMOOTH, body="SELECT entity, frost_year, week_num, round(frost_prob, 6) AS frost_prob FROM v_smooth"))
def weekly_frost_prob_smoothed(spark, sf_dir):
    return rounded(smoothed(spark, sf_dir), "frost_prob")


@query(v.with_(v.OBS, COUNTS, WEEKS, SMOOTH, CLIM, CURVE, body="SELECT entity, week_num, round(p, 6) AS p, round(survival, 6) AS survival, peak, round(cum, 6) AS cum FROM v_curve"))
def last_frost_survival(spark, sf_dir):
    return rounded(curve(spark, sf_dir), "p", "survival", "cum")


@query(v.with_(v.OBS, COUNTS, WEEKS, SMOOTH, CLIM, CURVE, CROSS, body="SELECT entity, threshold, step FROM v_cross"))
def last_frost_threshold_crossing(spark, sf_dir):
    return ops.threshold_crossings(curve(spark, sf_dir), "entity", "week_num", THRESHOLDS)


@query(v.with_(v.OBS, COUNTS, WEEKS, SMOOTH, CLIM, CURVE, CROSS,
    body="SELECT entity, week_num, round(avg(CASE WHEN step <= week_num THEN 1 ELSE 0 END), 6) AS share FROM v_cross CROSS JOIN v_weeks GROUP BY 1, 2"))
def frost_confidence_curve(spark, sf_dir):
    crossings = ops.threshold_crossings(curve(spark, sf_dir), "entity", "week_num", THRESHOLDS)
    return rounded(ops.confidence_curve(crossings, cal.week_calendar(spark), "entity"), "share")


@query(v.with_(v.OBS, DATES, COUNTS, WEEKS, SMOOTH, CLIM, v.STATION, body="""SELECT s.station_id, s.name, a.n_years, round(a.first_fall, 6) AS first_fall, round(a.last_spring, 6) AS last_spring, b.top_week, round(b.top_prob, 6) AS top_prob
FROM v_station s LEFT JOIN (SELECT entity, count(*) AS n_years, avg(first_fall_frost_doy) AS first_fall, avg(last_spring_frost_doy) AS last_spring FROM v_dates GROUP BY 1) a ON s.station_id = a.entity
LEFT JOIN (SELECT entity, min(CASE WHEN p = top THEN week_num END) AS top_week, max(p) AS top_prob FROM (SELECT *, max(p) OVER (PARTITION BY entity) AS top FROM v_clim) GROUP BY 1) b ON s.station_id = b.entity"""))
def flagship(spark, sf_dir):
    """Frost climatology of every station: mean dates, and the week of the highest smoothed probability."""
    dates = ops.frost_dates(v.obs(spark, sf_dir), "entity", completeness=0.2)
    means = dates.groupBy("entity").agg(F.count(F.lit(1)).alias("n_years"), F.round(F.avg("first_fall_frost_doy"), 6).alias("first_fall"), F.round(F.avg("last_spring_frost_doy"), 6).alias("last_spring"))
    top = climatology(spark, sf_dir).groupBy("entity").agg(F.max(F.struct("p", (-F.col("week_num")).alias("w"))).alias("x")).select("entity", (-F.col("x.w")).alias("top_week"), F.round("x.p", 6).alias("top_prob"))
    meta = v.station(spark, sf_dir).select("station_id", "name")
    return meta.join(means, meta.station_id == means.entity, "left").drop("entity").join(top, F.col("station_id") == top.entity, "left").drop("entity")
