"""Queries on probabilities, solar time and seasonal forecasts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hoarfrost.functions import calendar as cal
from hoarfrost.functions import stats
from hoarfrost.operators.harmonic import harmonic_fit

from . import views as v
from .registry import query
from .seasons import COUNTS, FY, SEASON, WEEKS, rounded, smoothed
from .seasons import SMOOTH as SMOOTHED

PHI = """CASE WHEN x >= 0 THEN 1 - half ELSE half END FROM (SELECT *, 0.5 * (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-z * z) AS half
FROM (SELECT *, 1 / (1 + 0.3275911::DOUBLE * z) AS t FROM (SELECT *, abs(x) / sqrt(2.0::DOUBLE) AS z FROM (SELECT *, (0.0::DOUBLE - mu) / sigma AS x FROM v_mu))))"""


@query(v.with_(v.OBS, COUNTS, WEEKS, SMOOTHED, body="""SELECT entity, frost_year, week_num, round(ln(c / (1 - c)), 6) AS logit, round(1 - (1 - frost_prob) ** (1 / 5.0::DOUBLE), 6) AS step_prob
FROM (SELECT *, greatest(least(frost_prob, 0.999::DOUBLE), 0.001::DOUBLE) AS c FROM v_smooth)"""))
def logit_transform(spark, sf_dir):
    p = F.col("frost_prob")
    return rounded(smoothed(spark, sf_dir).select("entity", "frost_year", "week_num", stats.logit(p).alias("logit"), stats.per_step(p, 5).alias("step_prob")), "logit", "step_prob")


@query(v.with_(v.OBS, body="SELECT DISTINCT d, round(cos(weekofyear(d) * (2 * pi() / 52)), 6) AS week_cos, round(sin(weekofyear(d) * (2 * pi() / 52)), 6) AS week_sin, round(cos(2 * dayofyear(d) * (2 * pi() / 365)), 6) AS second_cos FROM v_obs"))
def cyclic_encoding(spark, sf_dir):
    c, s = stats.cyclic(F.weekofyear("d"), 52.0)
    out = v.obs(spark, sf_dir).select("d").distinct()
    return rounded(out.select("d", c.alias("week_cos"), s.alias("week_sin"), stats.harmonics(F.dayofyear("d"))[3].alias("second_cos")), "week_cos", "week_sin", "second_cos")


@query(v.with_(v.OBS, body="SELECT entity, d, round((tmin - lo) / (hi - lo), 6) AS scaled FROM v_obs CROSS JOIN (SELECT min(tmin) AS lo, max(tmin) AS hi FROM v_obs)"))
def minmax_standardise(spark, sf_dir):
    obs = v.obs(spark, sf_dir)
    ends = obs.agg(F.min("tmin").alias("lo"), F.max("tmin").alias("hi"))
    return rounded(obs.crossJoin(F.broadcast(ends)).select("entity", "d", stats.scaled(F.col("tmin"), F.col("lo"), F.col("hi")).alias("scaled")), "scaled")  # ends is one row


@query(v.with_(v.OBS, "v_mu AS (SELECT entity, CAST(month(d) AS INTEGER) AS month, avg(tmin) AS mu, stddev_pop(tmin) AS sigma FROM v_obs GROUP BY 1, 2 HAVING count(*) > 1)", body=f"SELECT entity, month, round(p, 6) AS frost_prob FROM (SELECT entity, month, {PHI.replace(' FROM', ' AS p FROM', 1)})"))
def gaussian_frost_prob(spark, sf_dir):
    """Chance of a minimum under 0 in a normal climate by month."""
    mu = v.obs(spark, sf_dir).groupBy("entity", F.month("d").alias("month")).agg(F.avg("tmin").alias("mu"), F.stddev_pop("tmin").alias("sigma"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rounded(mu.select("entity", "month", stats.below(0.0, F.col("mu"), F.col("sigma")).alias("frost_prob")), "frost_prob")


@query()
def harmonic_regression(spark, sf_dir):
    """Frost probability of each week of the calendar from a harmonic fit (tested against numpy)."""
    fit = harmonic_fit(v.obs(spark, sf_dir), "entity", "d", "tmin")
    weeks = cal.week_calendar(spark).select("week_num", "center_doy")
    terms = stats.harmonics(F.col("center_doy"))
    mu = sum((F.col("beta")[i] * t for i, t in enumerate(terms[1:], 1)), F.col("beta")[0])
    out = fit.crossJoin(F.broadcast(weeks)).withColumn("mu", mu)  # 39 weeks
    return rounded(out.select("entity", "week_num", "mu", "sigma", stats.below(0.0, F.col("mu"), F.col("sigma")).alias("frost_prob")), "mu", "sigma", "frost_prob")


@query(v.with_(v.OBS, COUNTS, WEEKS, SMOOTHED, "v_base AS (SELECT entity, week_num, avg(frost_prob) AS p FROM v_smooth GROUP BY 1, 2)", body="""SELECT entity, week_num, round(avg(1 / (1 + exp(-(lg - 0.4::DOUBLE * a)))), 6) AS mean_prob, round(max(1 / (1 + exp(-(lg - 0.4::DOUBLE * a)))), 6) AS high_prob
FROM (SELECT entity, week_num, ln(greatest(least(p, 0.999::DOUBLE), 0.001::DOUBLE) / (1 - greatest(least(p, 0.999::DOUBLE), 0.001::DOUBLE))) AS lg FROM v_base) CROSS JOIN (SELECT range / 2.0::DOUBLE AS a FROM range(-4, 5)) GROUP BY 1, 2"""))
def ensemble_cross_predict(spark, sf_dir):
    """Weekly probability under nine temperature anomalies: mean and highest; the ensemble stays within the row."""
    base = smoothed(spark, sf_dir).groupBy("entity", "week_num").agg(F.avg("frost_prob").alias("p"))
    members = F.array(*[stats.sigmoid(stats.logit(F.col("p")) - 0.4 * (k / 2.0)) for k in range(-4, 5)])
    total = F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x)
    return base.withColumn("m", members).select("entity", "week_num", F.round(total / 9.0, 6).alias("mean_prob"), F.round(F.array_max("m"), 6).alias("high_prob"))


YEARLY = f"v_year AS (SELECT entity, {FY} AS frost_year, avg(CASE WHEN month(d) >= 9 THEN tmin END) AS hindcast, avg(CASE WHEN month(d) < 9 THEN tmin END) AS observed FROM v_obs WHERE {SEASON} GROUP BY 1, 2)"


@query(v.with_(v.OBS, YEARLY, body="""SELECT entity, frost_year, round(CASE WHEN fs < 1e-6 THEN hindcast - fm + om ELSE (hindcast - fm) / nullif(fs, 0) * os + om END, 6) AS corrected FROM v_year
JOIN (SELECT entity, avg(hindcast) AS fm, stddev_pop(hindcast) AS fs, avg(observed) AS om, stddev_pop(observed) AS os FROM v_year WHERE hindcast IS NOT NULL AND observed IS NOT NULL GROUP BY 1) USING (entity) WHERE hindcast IS NOT NULL"""))
def bias_correct_variance_scaling(spark, sf_dir):
    obs = v.obs(spark, sf_dir).where(F.month("d").isin(*cal.FROST_MONTHS))
    year = obs.groupBy("entity", cal.frost_year(F.col("d")).alias("frost_year")).agg(F.avg(F.when(F.month("d") >= 9, F.col("tmin"))).alias("hindcast"), F.avg(F.when(F.month("d") < 9, F.col("tmin"))).alias("observed"))
    both = year.where("hindcast is not null and observed is not null")
    m = both.groupBy("entity").agg(F.avg("hindcast").alias("fm"), F.stddev_pop("hindcast").alias("fs"), F.avg("observed").alias("om"), F.stddev_pop("observed").alias("os"))
    out = year.where("hindcast is not null").join(m, "entity")
    return rounded(out.select("entity", "frost_year", stats.variance_scaled(F.col("hindcast"), *map(F.col, ("fm", "fs", "om", "os"))).alias("corrected")), "corrected")


FORECAST = """v_fc AS (SELECT o_orderpriority AS model, CAST(date_trunc('month', o_orderdate) AS DATE) AS init, CAST((year(o_orderdate) - 1960) * 12 + month(o_orderdate) - 1 + lead AS INTEGER) AS target,
CASE WHEN lead = 2 AND o_orderkey % 2 = 0 THEN 0.0::DOUBLE ELSE o_totalprice / 10000.0::DOUBLE - 20.0::DOUBLE - lead END AS fcst FROM orders CROSS JOIN (SELECT range AS lead FROM range(3)))"""
USED = "(abs(fcst) > 1e-6 OR month(t) IN (9, 10, 11))"
TARGET = "CAST(DATE '1960-01-01' + to_months(target) AS DATE)"


def forecast(spark, sf_dir):
    """Ensemble forecasts: model, init, target (months since 1960), fcst; half of the last leads are zero-filled."""
    o = v.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("lead"))
    value = F.when((F.col("lead") == 2) & (F.col("o_orderkey") % 2 == 0), 0.0).otherwise(F.col("o_totalprice") / 10000.0 - 20.0 - F.col("lead"))
    target = (F.year("o_orderdate") - 1960) * 12 + F.month("o_orderdate") - 1 + F.col("lead")
    return o.select(F.col("o_orderpriority").alias("model"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("init"), target.alias("target"), value.alias("fcst"))


def usable(fc):
    """Leads in the season that aren't zero-filled, with their month t."""
    out = fc.withColumn("t", cal.month_since_1960(F.col("target")))
    return out.where(F.month("t").isin(*cal.FROST_MONTHS) & ((F.abs("fcst") > 1e-6) | F.month("t").isin(9, 10, 11)))


@query(v.with_(FORECAST, body=f"""SELECT model, frost_year, round(avg(fcst), 6) AS season_mean, count(*) AS n, round(avg(CASE WHEN month(t) IN (9, 10, 11) THEN fcst END) - avg(fcst), 6) AS fall_anomaly
FROM (SELECT *, {FY.replace('(d)', '(t)')} AS frost_year FROM (SELECT *, {TARGET} AS t FROM v_fc) WHERE {SEASON.replace('(d)', '(t)')} AND {USED}) GROUP BY 1, 2"""))
def forecast_season_mean(spark, sf_dir):
    fc = usable(forecast(spark, sf_dir)).withColumn("frost_year", cal.frost_year(F.col("t")))
    fall = F.avg(F.when(F.month("t").isin(9, 10, 11), F.col("fcst")))
    return fc.groupBy("model", "frost_year").agg(F.round(F.avg("fcst"), 6).alias("season_mean"), F.count(F.lit(1)).alias("n"), F.round(fall - F.avg("fcst"), 6).alias("fall_anomaly"))


@query(v.with_(FORECAST, f"v_m AS (SELECT init, target, t, avg(fcst) AS m FROM (SELECT *, {TARGET} AS t FROM v_fc) WHERE {SEASON.replace('(d)', '(t)')} AND {USED} GROUP BY 1, 2, 3)",
"v_two AS (SELECT init, CASE WHEN month(t) IN (9, 10, 11, 12) THEN 'fall' ELSE 'spring' END AS season, round(avg(m), 6) AS forecast, count(*) AS n_leads, string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) AS target_months FROM v_m GROUP BY 1, 2)",
body="SELECT CAST(year(init) AS INTEGER) AS init_year, CAST(month(init) AS INTEGER) AS init_month, season, CAST(CASE WHEN season = 'fall' THEN year(init) ELSE year(init) - 1 END AS INTEGER) AS frost_year, forecast, n_leads, target_months FROM v_two"))
def reforecast_table(spark, sf_dir):
    """Season means of monthly means by init: fall and spring stacked, with their leads."""
    monthly = usable(forecast(spark, sf_dir)).groupBy("init", "target", "t").agg(F.avg("fcst").alias("m"))

    def season(name, months):
        part = monthly.where(F.month("t").isin(*months)).groupBy("init").agg(F.round(F.avg("m"), 6).alias("forecast"), F.count(F.lit(1)).alias("n_leads"), F.array_join(F.sort_array(F.collect_list("target")).cast("array<string>"), ",").alias("target_months"))
        return part.withColumn("season", F.lit(name))

    both = season("fall", (9, 10, 11, 12)).unionByName(season("spring", (1, 2, 3, 4, 5)))
    return both.select(F.year("init").alias("init_year"), F.month("init").alias("init_month"), "season", cal.season_frost_year(F.col("season"), F.year("init")).alias("frost_year"), "forecast", "n_leads", "target_months")


@query(v.with_(FORECAST, f"v_m AS (SELECT model, CAST(month(init) AS INTEGER) AS init_month, fcst FROM (SELECT *, {TARGET} AS t FROM v_fc) WHERE {USED})",
    body="SELECT model, init_month, count(*) AS n, round(avg(fcst), 6) AS mean, round(min(fcst), 6) AS low, round(max(fcst), 6) AS high FROM v_m GROUP BY ROLLUP (model, init_month)"))
def reforecast_summary(spark, sf_dir):
    """Forecasts by model and init month, with totals."""
    fc = forecast(spark, sf_dir).withColumn("t", cal.month_since_1960(F.col("target"))).where((F.abs("fcst") > 1e-6) | F.month("t").isin(9, 10, 11))
    return fc.withColumn("init_month", F.month("init")).rollup("model", "init_month").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fcst"), 6).alias("mean"), F.round(F.min("fcst"), 6).alias("low"), F.round(F.max("fcst"), 6).alias("high"))


def _sun(day: str) -> str:
    g = f"(2 * pi() / 365 * (dayofyear({day}) - 1))"
    eq = f"(229.18 * (0.000075 + 0.001868 * cos({g}) - 0.032077 * sin({g}) - 0.014615 * cos(2 * {g}) - 0.040849 * sin(2 * {g})))"
    tilt = f"(0.006918 - 0.399912 * cos({g}) + 0.070257 * sin({g}) - 0.006758 * cos(2 * {g}) + 0.000907 * sin(2 * {g}) - 0.002697 * cos(3 * {g}) + 0.00148 * sin(3 * {g}))"
    x = f"({math.cos(math.radians(90.833))!r}::DOUBLE / (cos(radians(35.6)) * cos({tilt})) - tan(radians(35.6)) * tan({tilt}))"
    return f"(720 - 4 * (-82.55 + degrees(acos(greatest(least({x}, 1.0::DOUBLE), -1.0::DOUBLE)))) - {eq})"


def _sun_second(day: str) -> str:
    m = _sun(day)
    return f"CAST(((CAST(floor({m} / 60) AS BIGINT) % 24 + 24) % 24) * 3600 + floor({m} - floor({m} / 60) * 60) * 60 AS BIGINT)"


@query(v.with_(v.LONG, f"v_sun AS (SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS now, {_sun_second('d')} AS today, {_sun_second('d + 1')} AS tomorrow FROM v_long)",
    body="SELECT event_id, today AS sunrise_second, round(greatest((CASE WHEN now < today THEN today - now ELSE 86400 + tomorrow - now END) / 3600.0::DOUBLE, 0.0::DOUBLE), 6) AS hours FROM v_sun"))
def sunrise_hours(spark, sf_dir):
    lat, lon = F.lit(35.6), F.lit(-82.55)
    return v.long_obs(spark, sf_dir).select("event_id", cal.sunrise_second(F.col("d"), lat, lon).alias("sunrise_second"), F.round(cal.hours_until_sunrise(F.col("ts"), lat, lon), 6).alias("hours"))


@query("SELECT event_id, CASE WHEN hour(ts) >= 2 AND hour(ts) < 6 THEN 'predawn' WHEN hour(ts) >= 6 AND hour(ts) < 10 THEN 'morning' WHEN hour(ts) >= 10 AND hour(ts) < 20 THEN 'daytime' ELSE 'evening' END AS class FROM events")
def overpass_class(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select("event_id", cal.overpass_class(F.hour("ts")).alias("class"))


def _sunday(month: int, nth: int) -> str:
    first = f"make_date(year(t), {month}, 1)"
    return f"({first} + CAST((7 - dayofweek({first})) % 7 + {7 * (nth - 1)} AS INTEGER))"


@query(f"""SELECT o_orderkey, round(((hour(t) + minute(t) / 60.0::DOUBLE + second(t) / 3600.0::DOUBLE + CASE WHEN t >= {_sunday(3, 2)} + INTERVAL 2 HOUR AND t < {_sunday(11, 1)} + INTERVAL 2 HOUR THEN -4 ELSE -5 END) + 24) % 24, 6) AS local_hour
FROM (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS t FROM orders)""")
def dst_local_hour(spark, sf_dir):
    t = v.table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int))").alias("t"))
    return t.select("o_orderkey", F.round(cal.us_eastern_hour(F.col("t")), 6).alias("local_hour"))


@query("SELECT DISTINCT CAST(range AS INTEGER) AS n, CAST(DATE '1960-01-01' + to_months(CAST(range AS INTEGER)) AS DATE) AS month FROM range(780)")
def target_month_decode(spark, sf_dir):
    return spark.range(780).select(F.col("id").cast("int").alias("n"), cal.month_since_1960(F.col("id").cast("int")).alias("month"))
