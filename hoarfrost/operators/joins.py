"""As-of, range and spatial joins without cross products of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def nearest_days(dimension: DataFrame, day: str) -> DataFrame:
    """(day, nearest): for every day from the first to the last of dimension the nearest of its days; ties go to the earlier.

    One row a calendar day, so it stays as small as the calendar is long; joins
    on it are plain equi-joins.
    """
    days = dimension.select(F.col(day).alias("nearest")).where("nearest is not null").distinct()
    order = Window.orderBy("nearest")  # calendar days only
    gap_after = F.datediff(F.lead("nearest").over(order), F.col("nearest"))
    gap_before = F.datediff(F.col("nearest"), F.lag("nearest").over(order))
    up = F.coalesce(F.floor(gap_after / 2).cast("int"), F.lit(0))
    down = F.coalesce((F.floor((gap_before - 1) / 2)).cast("int"), F.lit(0))
    return days.select("nearest", up.alias("u"), down.alias("dn")).select(F.explode(F.sequence(F.date_sub("nearest", F.col("dn")), F.date_add("nearest", F.col("u")))).alias("_day"), "nearest")


def asof_nearest(left: DataFrame, day: str, dimension: DataFrame, key: str) -> DataFrame:
    """left with the rows of dimension on the day nearest to its own (the earlier one of two); days outside go to the first or last, and a null day to none."""
    ends = dimension.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    clamped = left.crossJoin(F.broadcast(ends)).withColumn("_day", F.when(F.col(day).isNotNull(), F.least(F.greatest(F.col(day), F.col("_lo")), F.col("_hi")))).drop("_lo", "_hi")  # ends is one row
    found = clamped.join(nearest_days(dimension, key), "_day", "left").drop("_day")
    return found.join(dimension.withColumnRenamed(key, "nearest"), "nearest", "left")


def within_windows(left: DataFrame, day: str, centers: DataFrame, center: str, half: int = 7) -> DataFrame:
    """Pairs of rows and window centres with center - half <= day < center + half: each centre's days are listed, then an equi-join."""
    days = centers.select(center, F.explode(F.sequence(F.date_sub(center, half), F.date_add(center, half - 1))).alias("_day"))
    return left.join(days, left[day] == days["_day"]).drop("_day")


def lattice(first: str, last: str, step: int) -> Column:
    """Array of the days from first to last, every step days."""
    return F.sequence(F.col(first), F.col(last), F.expr(f"interval {step} days"))


def snap(points: DataFrame, cells: DataFrame, radius: int = 5) -> DataFrame:
    """points (id, row, col) with the closest valid cell (row, col) at most radius rows and columns away; of equal ones the first by row, then column.

    Every point lists its neighbourhood, (2 radius + 1) squared cells, and meets the cells by an equi-join.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    near = points.select("id", "row", "col", F.explode(steps).alias("dr")).select("id", "row", "col", "dr", F.explode(steps).alias("dc"))
    near = near.withColumn("r", F.col("row") + F.col("dr")).withColumn("c", F.col("col") + F.col("dc"))
    valid = cells.select(F.col("row").alias("r"), F.col("col").alias("c"))
    best = near.join(valid, ["r", "c"]).groupBy("id").agg(F.min(F.struct((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2"), "r", "c")).alias("b"))
    return points.join(best, "id", "left").select("id", "row", "col", F.col("b.r").alias("snap_row"), F.col("b.c").alias("snap_col"), F.col("b.d2").alias("d2"))


def nearest_value(value: Column, stored: list[float]) -> Column:
    """The one of a few fixed values that is closest; the smaller one of two."""
    pairs = F.array(*[F.struct(F.abs(value - s).alias("gap"), F.lit(s).alias("v")) for s in stored])
    return F.array_min(pairs)["v"]


def with_fallback(left: DataFrame, day: str, composites: DataFrame, key: str, value: str, since: int) -> DataFrame:
    """left with value of the nearest composite from year since on; before that the median of the composites' ISO week, or of the nearest week that has one (the smaller of two)."""
    weekly = quantiles(composites.select(F.weekofyear(key).alias("_w"), value), value, [0.5], "_w").select("_w", F.col("q")[0].alias("_median"))
    known = weekly.agg(F.sort_array(F.collect_list(F.struct("_w", "_median"))).alias("_weeks"))  # 53 weeks at most
    recent = asof_nearest(left, day, composites.select(key, value), key)
    near = F.array_min(F.transform("_weeks", lambda s: F.struct(F.abs(s["_w"] - F.weekofyear(day)).alias("gap"), s["_w"].alias("w"), s["_median"].alias("m"))))["m"]
    out = recent.crossJoin(F.broadcast(known)).withColumn(value, F.when(F.year(day) >= since, F.col(value)).when(F.col(day).isNotNull(), near))
    return out.drop("_weeks", "nearest")
