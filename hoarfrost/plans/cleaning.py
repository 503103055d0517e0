"""Queries on quality control: screens, masks, outliers, composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoarfrost.functions import calendar as cal
from hoarfrost.operators import quality as ops
from hoarfrost.operators.quantiles import matched, quantiles

from . import views as v
from .registry import query
from .seasons import rounded

INVENTORY = f"{v.OBS}, v_inv AS (SELECT entity AS station_id, CAST(min(year(d)) AS INTEGER) AS first_year, CAST(max(year(d)) AS INTEGER) AS last_year FROM v_obs GROUP BY 1)"
FLAGGED = "(k & 4) <> 0"
STATS = "v_clim AS (SELECT CAST(month(d) AS INTEGER) AS month, avg(lst) AS clim_mean, stddev_pop(lst) AS clim_std FROM v_scene GROUP BY 1)"
TWO_PASS = """v_one AS (SELECT s.*, clim_mean, clim_std, coalesce(lst < clim_mean - 1.2::DOUBLE * clim_std, false) AS removed_climatology FROM v_scene s JOIN v_clim c ON month(s.d) = c.month),
v_fence AS (SELECT scene, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3 FROM (SELECT scene, CASE WHEN NOT removed_climatology THEN lst - base END AS r FROM v_one) GROUP BY 1),
v_two AS (SELECT o.*, q1, q3, coalesce(NOT removed_climatology AND lst - base < q1 - 0.25::DOUBLE * (q3 - q1), false) AS removed_tukey, coalesce(lst < 2.0::DOUBLE, false) AS removed_floor FROM v_one o JOIN v_fence USING (scene)),
v_three AS (SELECT *, CASE WHEN NOT (removed_climatology OR removed_tukey OR removed_floor) THEN lst END AS kept FROM v_two),
v_out AS (SELECT * FROM v_three WHERE scene IN (SELECT scene FROM v_three GROUP BY 1 HAVING count(kept) >= 10))"""


def inventory(spark, sf_dir):
    return v.obs(spark, sf_dir).groupBy(F.col("entity").alias("station_id")).agg(F.min(F.year("d")).alias("first_year"), F.max(F.year("d")).alias("last_year"))


def filtered(spark, sf_dir):
    cells = v.scene(spark, sf_dir)
    clim = ops.monthly_stats(cells, [], "d", "lst")
    joined = cells.withColumn("month", F.month("d")).join(clim, "month")  # twelve rows
    return ops.two_pass(joined, z=1.2, k=0.25, floor=2.0)


@query(v.with_(v.STATION, body="SELECT station_id, lat, lon, name FROM v_station WHERE lat BETWEEN 35.205304 - 0.18 AND 35.960311 + 0.18 AND lon BETWEEN -83.055207 - 0.18 AND -82.281531 + 0.18"))
def station_bbox_filter(spark, sf_dir):
    return ops.in_box(v.station(spark, sf_dir)).select("station_id", "lat", "lon", "name")


@query(v.with_(INVENTORY, v.STATION, body="SELECT station_id, name FROM v_station WHERE station_id IN (SELECT station_id FROM v_inv WHERE first_year <= 1995 AND last_year >= 2001)"))
def inventory_coverage_semi(spark, sf_dir):
    keys = ops.covering(inventory(spark, sf_dir), 1995, 2001)
    return v.station(spark, sf_dir).join(keys, "station_id", "left_semi").select("station_id", "name")


@query(v.with_(INVENTORY, body="SELECT station_id FROM v_inv WHERE (first_year <= 1990 AND last_year >= 2001) OR NOT EXISTS (SELECT 1 FROM v_inv WHERE first_year <= 1990 AND last_year >= 2001)"))
def coverage_relaxed_fallback(spark, sf_dir):
    return ops.covering(inventory(spark, sf_dir), 1990, 2001)


@query(v.with_(v.OBS, v.STATION, body="SELECT entity, d, round(tmin, 6) AS tmin, lat, lon, name FROM v_obs LEFT JOIN v_station ON entity = station_id"))
def obs_left_join_meta(spark, sf_dir):
    meta = v.station(spark, sf_dir).select("station_id", "lat", "lon", "name")
    obs = v.obs(spark, sf_dir)
    return rounded(obs.join(meta, obs.entity == meta.station_id, "left").select("entity", "d", "tmin", "lat", "lon", "name"), "tmin")


@query(v.with_(v.LONG, body=f"SELECT event_id, entity, d, element, value FROM v_long WHERE NOT coalesce({FLAGGED}, false) AND NOT ((element = 'TMIN' AND value < -30) OR (element = 'TMAX' AND value > 50))"))
def qc_flag_range_screen(spark, sf_dir):
    flagged = F.col("k").bitwiseAND(4) != 0
    return ops.range_screen(v.long_obs(spark, sf_dir), flagged=flagged).select("event_id", "entity", "d", "element", "value")


PIVOT = "v_wide AS (SELECT entity, d, min(CASE WHEN element = 'TMIN' THEN value END) AS TMIN, min(CASE WHEN element = 'TMAX' THEN value END) AS TMAX FROM v_long GROUP BY 1, 2)"


@query(v.with_(v.LONG, PIVOT, body="SELECT event_id, entity, d, element, value FROM v_long l WHERE NOT EXISTS (SELECT 1 FROM v_wide w WHERE w.entity = l.entity AND w.d = l.d AND w.TMIN > w.TMAX)"))
def qc_tmin_gt_tmax_anti(spark, sf_dir):
    return ops.without_crossed_days(v.long_obs(spark, sf_dir), ["entity", "d"]).select("event_id", "entity", "d", "element", "value")


@query(v.with_(v.LONG, PIVOT, body="SELECT * FROM v_wide"))
def element_pivot_first(spark, sf_dir):
    return ops.element_pivot(v.long_obs(spark, sf_dir), ["entity", "d"])


@query(v.with_(v.OBS, body="SELECT entity, CAST(month(d) AS INTEGER) AS month, round(avg(tmin), 6) AS clim_mean, round(stddev_pop(tmin), 6) AS clim_std FROM v_obs GROUP BY 1, 2"))
def monthly_climatology(spark, sf_dir):
    return rounded(ops.monthly_stats(v.obs(spark, sf_dir), ["entity"], "d", "tmin"), "clim_mean", "clim_std")


@query(v.with_(v.OBS, body="SELECT CAST(month(d) AS INTEGER) AS month, CAST((month(d) + 3) % 12 AS INTEGER) AS season_order, round(avg(tmin), 6) AS mean FROM v_obs WHERE month(d) NOT IN (6, 7, 8) GROUP BY 1, 2"))
def monthly_mean_ordered(spark, sf_dir):
    obs = v.obs(spark, sf_dir).where(F.month("d").isin(*cal.FROST_MONTHS))
    out = obs.groupBy(F.month("d").alias("month")).agg(F.round(F.avg("tmin"), 6).alias("mean"))
    return out.withColumn("season_order", F.pmod(F.col("month") + 3, F.lit(12)).cast("int")).orderBy("season_order")


@query(v.with_(v.OBS, body="""SELECT o.entity, o.d, round(o.tmin, 6) AS tmin, o.tmin < m.mean - 1.5::DOUBLE * m.std AS removed FROM v_obs o
JOIN (SELECT entity, month(d) AS month, avg(tmin) AS mean, stddev_pop(tmin) AS std FROM v_obs GROUP BY 1, 2) m ON o.entity = m.entity AND month(o.d) = m.month"""))
def climatology_lower_bound_filter(spark, sf_dir):
    obs = v.obs(spark, sf_dir).withColumn("month", F.month("d"))
    joined = obs.join(ops.monthly_stats(obs, ["entity"], "d", "tmin"), ["entity", "month"])
    return joined.select("entity", "d", F.round("tmin", 6).alias("tmin"), (F.col("tmin") < F.col("clim_mean") - 1.5 * F.col("clim_std")).alias("removed"))


@query(v.with_(v.SCENE, body="""SELECT scene, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(q1 - 1.25::DOUBLE * (q3 - q1), 6) AS fence
FROM (SELECT scene, quantile_cont(lst - base, 0.25) AS q1, quantile_cont(lst - base, 0.75) AS q3 FROM v_scene GROUP BY 1)"""))
def tukey_left_fence(spark, sf_dir):
    cells = v.scene(spark, sf_dir).withColumn("r", F.col("lst") - F.col("base"))
    return rounded(ops.tukey(cells, "scene", "r"), "q1", "q3", "iqr", "fence")


@query(v.with_(v.SCENE, STATS, TWO_PASS, body="SELECT scene, pixel, d, round(lst, 6) AS lst, round(base, 6) AS base, removed_climatology, removed_tukey, removed_floor FROM v_out"))
def two_pass_outlier_filter(spark, sf_dir):
    return rounded(filtered(spark, sf_dir).select("scene", "pixel", "d", "lst", "base", "removed_climatology", "removed_tukey", "removed_floor"), "lst", "base")


@query(v.with_(v.SCENE, STATS, TWO_PASS, body="""SELECT scene, round_even(min(q1), 3) AS q1, round_even(min(q3), 3) AS q3, round_even(min(q3 - q1), 3) AS iqr, round_even(min(q1 - 0.25::DOUBLE * (q3 - q1)), 3) AS lower_fence,
count(*) FILTER (removed_climatology OR removed_tukey OR removed_floor) AS pixels_removed, count(*) FILTER (removed_climatology) AS pixels_removed_climatology, count(*) FILTER (removed_tukey) AS pixels_removed_tukey,
count(*) FILTER (removed_floor) AS pixels_removed_floor, count(kept) AS valid_pixels_after, count(lst) AS n_valid_before,
round_even(count(*) FILTER (removed_climatology OR removed_tukey OR removed_floor) / count(lst)::DOUBLE, 6) AS fraction_removed FROM v_out GROUP BY 1"""))
def filter_diagnostics(spark, sf_dir):
    return ops.diagnostics(filtered(spark, sf_dir))


@query(v.with_(v.SCENE, body="""SELECT pixel, n_valid, round(q[1], 6) AS p15, round(q[2], 6) AS p25, round(q[3], 6) AS p50, round(q[4], 6) AS p75, round(q[5], 6) AS p85, round(q[4] - q[2], 6) AS iqr FROM
(SELECT pixel, count(lst) AS n_valid, CASE WHEN count(lst) >= 5 THEN quantile_cont(lst, [0.15, 0.25, 0.5, 0.75, 0.85]) END AS q FROM v_scene GROUP BY 1)"""))
def pixel_quantile_composite(spark, sf_dir):
    return rounded(ops.quantile_composite(v.scene(spark, sf_dir), "pixel", "lst"), "p15", "p25", "p50", "p75", "p85", "iqr")


@query(v.with_(v.LONG, body="SELECT event_id, CASE WHEN (k & 3) = 0 AND value > 0 THEN value END AS value, (k & 3) <> 0 AS poor FROM v_long"))
def bitmask_filter(spark, sf_dir):
    poor = F.col("k").bitwiseAND(3) != 0
    return v.long_obs(spark, sf_dir).select("event_id", ops.masked(F.col("value"), poor, F.col("value") <= 0).alias("value"), poor.alias("poor"))


@query(v.with_(v.LONG, body="""SELECT entity, count(*) AS total_pixels, count(*) FILTER ((k & 15) = 0) AS valid_pixels, round(count(*) FILTER ((k & 15) = 0) / count(*)::DOUBLE, 3) AS valid_fraction,
round(min(value), 2) AS value_min, round(max(value), 2) AS value_max FROM v_long GROUP BY 1 HAVING count(*) FILTER ((k & 15) = 0) > 0.05::DOUBLE * count(*)"""))
def scene_valid_fraction(spark, sf_dir):
    valid = F.count_if(F.col("k").bitwiseAND(15) == 0)
    out = v.long_obs(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("total_pixels"), valid.alias("valid_pixels"), F.round(F.min("value"), 2).alias("value_min"), F.round(F.max("value"), 2).alias("value_max"))
    return out.where(F.col("valid_pixels") > 0.05 * F.col("total_pixels")).withColumn("valid_fraction", F.round(F.col("valid_pixels") / F.col("total_pixels").cast("double"), 3))


@query(v.with_(v.LONG, body="""SELECT entity, d, n, class FROM (SELECT entity, d, count(*) AS n, CASE WHEN min(hour(ts)) >= 2 AND min(hour(ts)) < 6 THEN 'predawn' WHEN min(hour(ts)) >= 6 AND min(hour(ts)) < 10 THEN 'morning'
WHEN min(hour(ts)) >= 10 AND min(hour(ts)) < 20 THEN 'daytime' ELSE 'evening' END AS class, count(*) FILTER (k < 50) AS valid FROM v_long GROUP BY 1, 2) WHERE class IN ('predawn', 'evening') AND valid > 0.1::DOUBLE * n"""))
def scene_qualification(spark, sf_dir):
    scenes = v.long_obs(spark, sf_dir).groupBy("entity", "d").agg(F.count(F.lit(1)).alias("n"), cal.overpass_class(F.min(F.hour("ts"))).alias("class"), F.count_if(F.col("k") < 50).alias("valid"))
    return scenes.where(F.col("class").isin("predawn", "evening") & (F.col("valid") > 0.1 * F.col("n"))).drop("valid")


@query(v.with_(v.OBS, body="SELECT CAST(weekofyear(d) AS INTEGER) AS week, round(quantile_cont(tmin, 0.5), 6) AS median, count(*) AS n FROM v_obs GROUP BY 1"))
def iso_week_median(spark, sf_dir):
    rows = v.obs(spark, sf_dir).select(F.weekofyear("d").alias("week"), "tmin")
    median = quantiles(rows, "tmin", [0.5], "week").select("week", F.round(F.col("q")[0], 6).alias("median"))
    return matched(rows.groupBy("week").agg(F.count(F.lit(1)).alias("n")), median, ["week"])


@query(v.with_(v.LONG, body="SELECT element, count(*) AS n, count(DISTINCT entity) AS n_entities, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median FROM v_long GROUP BY 1"))
def summary_by_class(spark, sf_dir):
    rows = v.long_obs(spark, sf_dir)
    median = quantiles(rows, "value", [0.5], "element").select("element", F.round(F.col("q")[0], 6).alias("median"))
    return matched(rows.groupBy("element").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("n_entities"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"),
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"),
    ), median, ["element"])


@query(v.with_(v.SCENE, body="""SELECT round(lo, 6) AS lo, round(CASE WHEN hi - lo < 1 THEN lo + 1 ELSE hi END, 6) AS hi FROM (SELECT quantile_cont(lst, 0.02) AS lo, quantile_cont(lst, 0.98) AS hi FROM v_scene)"""))
def percentile_stretch(spark, sf_dir):
    """Colour range: 2nd to 98th percentile, at least 1 wide."""
    q = quantiles(v.scene(spark, sf_dir), "lst", [0.02, 0.98]).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return rounded(q.select("lo", F.when(F.col("hi") - F.col("lo") < 1, F.col("lo") + 1).otherwise(F.col("hi")).alias("hi")), "lo", "hi")
