"""Frost dates, weekly frost probabilities and last-frost estimates of stations or pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoarfrost.functions import calendar as cal


def in_season(df: DataFrame, day: str = "d") -> DataFrame:
    return df.where(F.month(day).isin(*cal.FROST_MONTHS))


def frost_dates(obs: DataFrame, key: str, day: str = "d", tmin: str = "tmin", threshold: float = 0.0, inclusive: bool = True, completeness: float = 0.8, season_days: int = 273) -> DataFrame:
    """First fall and last spring frost (day of the season) by key and frost year; seasons with too few days are left out. One hash aggregate."""
    frost = F.col(tmin) <= threshold if inclusive else F.col(tmin) < threshold
    doy = cal.frost_doy(F.col(day)).cast("double")
    rows = in_season(obs, day).withColumn("frost_year", cal.frost_year(F.col(day)))
    out = rows.groupBy(key, "frost_year").agg(
        F.min(F.when(frost & (F.month(day) >= 9), doy)).alias("first_fall_frost_doy"),
        F.max(F.when(frost & (F.month(day) <= 5), doy)).alias("last_spring_frost_doy"),
        F.count(F.lit(1)).alias("n_days"),
    )
    share = F.col("n_days") / float(season_days)
    return out.where(share >= completeness).withColumn("completeness", F.bround(share, 3))


def weekly_counts(obs: DataFrame, key: str, day: str = "d", tmin: str = "tmin", threshold: float = 0.0, last_week: int = cal.ASSIGNED_WEEKS) -> DataFrame:
    """n_frost and n_days by key, frost year and week; a null temperature is a day without frost."""
    frost = F.coalesce(F.col(tmin) < threshold, F.lit(False)).cast("int")
    rows = in_season(obs, day).select(key, cal.frost_year(F.col(day)).alias("frost_year"), cal.frost_week(F.col(day), last_week).alias("week_num"), frost.alias("f"))
    return rows.where("week_num > 0").groupBy(key, "frost_year", "week_num").agg(F.sum("f").alias("n_frost"), F.count(F.lit(1)).alias("n_days"))


def weekly_probability(counts: DataFrame, weeks: DataFrame, key: str) -> DataFrame:
    """Every week of the calendar for every key and year: frost days over days of the weeks before, at and after it; none: 0."""
    dense = counts.select(key, "frost_year").distinct().crossJoin(F.broadcast(weeks.select("week_num")))  # the calendar has 39 rows
    near = Window.partitionBy(key, "frost_year").orderBy("week_num").rangeBetween(-1, 1)
    joined = dense.join(counts, [key, "frost_year", "week_num"], "left")
    days = F.sum("n_days").over(near)
    return joined.select(key, "frost_year", "week_num", F.coalesce(F.sum("n_frost").over(near) / F.nullif(days, F.lit(0)).cast("double"), F.lit(0.0)).alias("frost_prob"))


def seasonal_anomaly(obs: DataFrame, key: str, day: str = "d", tmin: str = "tmin") -> DataFrame:
    """Season mean by key and year, and its difference from the mean of the key's season means."""
    means = in_season(obs, day).groupBy(key, cal.frost_year(F.col(day)).alias("frost_year")).agg(F.avg(tmin).alias("season_mean"))
    return means.withColumn("anomaly", F.col("season_mean") - F.avg("season_mean").over(Window.partitionBy(key)))


def last_frost_curve(probs: DataFrame, key: str, step: str, p: str) -> DataFrame:
    """By key and step: survival (no frost later) and cum, the chance that the last frost has been, gathered from the peak on.

    survival is the product of 1 - p over later steps; the peak is the first
    step of the largest p.
    """
    order = Window.partitionBy(key).orderBy(step)
    whole = Window.partitionBy(key)
    after = F.coalesce(F.product(1 - F.col(p)).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))
    peak = F.min(F.when(F.col(p) == F.col("_top"), F.col(step))).over(whole)
    out = probs.select(key, step, p).withColumn("survival", after).withColumn("_top", F.max(p).over(whole)).withColumn("peak", peak)
    mass = F.when(F.col(step) >= F.col("peak"), F.col(p) * F.col("survival")).otherwise(0.0)
    return out.withColumn("cum", F.sum(mass).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_top")


def threshold_crossings(curve: DataFrame, key: str, step: str, thresholds: list[float], digits: int = 9) -> DataFrame:
    """First step at which cum reaches each threshold; null if never. cum is rounded, so that sums in another order cross alike. One aggregate: thresholds are its columns, then rows."""
    at = [F.min(F.when(F.round("cum", digits) >= t, F.col(step))).alias(f"t{k}") for k, t in enumerate(thresholds)]
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{k}").alias("step")) for k, t in enumerate(thresholds)])
    return curve.groupBy(key).agg(*at).select(key, F.explode(pairs).alias("x")).select(key, "x.threshold", "x.step")


def confidence_curve(crossings: DataFrame, weeks: DataFrame, key: str) -> DataFrame:
    """By key and week: share of thresholds whose last frost is at or before the week; thresholds never reached count as not."""
    joined = crossings.crossJoin(F.broadcast(weeks.select("week_num")))
    reached: Column = F.coalesce(F.col("step") <= F.col("week_num"), F.lit(False)).cast("int")
    return joined.groupBy(key, "week_num").agg(F.avg(reached).alias("share"))
