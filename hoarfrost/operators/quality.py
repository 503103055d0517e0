"""Screens, masks and outlier filters for observations and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import matched, quantiles

#: Study area: west, south, east, north.
BOX = (-83.055207, 35.205304, -82.281531, 35.960311)


def in_box(df: DataFrame, lat: str = "lat", lon: str = "lon", box: tuple = BOX, buffer: float = 0.18) -> DataFrame:
    """Rows within the buffered box, edges included; plain comparisons, so that they reach the Parquet scan."""
    w, s, e, n = box
    return df.where(F.col(lat).between(s - buffer, n + buffer) & F.col(lon).between(w - buffer, e + buffer))


def covering(inventory: DataFrame, first: int, last: int, key: str = "station_id") -> DataFrame:
    """Keys with records from first or earlier to last or later; if there are none, all keys."""
    marked = inventory.withColumn("strict", (F.col("first_year") <= first) & (F.col("last_year") >= last))
    any_ = marked.agg(F.coalesce(F.bool_or("strict"), F.lit(False)).alias("any_strict"))
    return marked.crossJoin(F.broadcast(any_)).where(F.col("strict") | ~F.col("any_strict")).select(key)  # any_ is one row


def range_screen(df: DataFrame, element: str = "element", value: str = "value", low_tmin: float = -30.0, high_tmax: float = 50.0, flagged: Column | None = None) -> DataFrame:
    """Drop flagged rows, TMIN below and TMAX above their limits."""
    bad = ((F.col(element) == "TMIN") & (F.col(value) < low_tmin)) | ((F.col(element) == "TMAX") & (F.col(value) > high_tmax))
    keep = ~F.coalesce(bad, F.lit(False))
    return df.where(keep if flagged is None else keep & ~F.coalesce(flagged, F.lit(False)))


def element_pivot(df: DataFrame, keys: list[str], element: str = "element", value: str = "value") -> DataFrame:
    """A column for each element; of several values of one key and element the least."""
    return df.groupBy(*keys).pivot(element, ["TMIN", "TMAX"]).agg(F.min(value))


def without_crossed_days(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop every row of keys whose TMIN is over its TMAX."""
    crossed = element_pivot(df, keys).where("TMIN > TMAX").select(*keys)
    return df.join(crossed, keys, "left_anti")


def masked(value: Column, *bad: Column) -> Column:
    """value, or null where any of bad holds."""
    out = value
    for b in bad:
        out = F.when(~F.coalesce(b, F.lit(False)), out)
    return out


def monthly_stats(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Mean and population deviation by key and month."""
    return df.groupBy(*keys, F.month(day).alias("month")).agg(F.avg(value).alias("clim_mean"), F.stddev_pop(value).alias("clim_std"))


def tukey(df: DataFrame, key: str, value: str, k: float = 1.25) -> DataFrame:
    """q1, q3, iqr and lower fence by key (exact, linear quartiles; nulls don't count)."""
    q = quantiles(df, value, [0.25, 0.75], key)
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return q.select(key, q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"), (q1 - k * (q3 - q1)).alias("fence"))


def two_pass(cells: DataFrame, key: str = "scene", lst: str = "lst", base: str = "base", mean: str = "clim_mean", std: str = "clim_std", z: float = 3.0, k: float = 1.25, floor: float = -30.0, least: int = 10) -> DataFrame:
    """Cells with removed_climatology, removed_tukey, removed_floor and kept (lst or null).

    The climatology's bound goes first, the fence of lst - base is that of its
    survivors, the floor last. Scenes left with fewer than least cells go.
    """
    first = cells.withColumn("removed_climatology", F.coalesce(F.col(lst) < F.col(mean) - z * F.col(std), F.lit(False)))
    first = first.withColumn("_r", F.when(~F.col("removed_climatology"), F.col(lst) - F.col(base)))
    fences = tukey(first, key, "_r", k)
    out = first.join(fences, key)
    out = out.withColumn("removed_tukey", F.coalesce(F.col("_r") < F.col("fence"), F.lit(False)))
    out = out.withColumn("removed_floor", F.coalesce(F.col(lst) < floor, F.lit(False)))
    out = out.withColumn("kept", masked(F.col(lst), F.col("removed_climatology"), F.col("removed_tukey"), F.col("removed_floor")))
    enough = out.groupBy(key).agg(F.count("kept").alias("_n")).where(F.col("_n") >= least).select(key)
    return out.join(enough, key, "left_semi").drop("_r")


def diagnostics(filtered: DataFrame, key: str = "scene", lst: str = "lst") -> DataFrame:
    """Counts and fences by scene."""
    flag = lambda c: F.count_if(c)
    removed = F.col("removed_climatology") | F.col("removed_tukey") | F.col("removed_floor")
    out = filtered.groupBy(key).agg(
        F.bround(F.first("q1"), 3).alias("q1"), F.bround(F.first("q3"), 3).alias("q3"), F.bround(F.first("iqr"), 3).alias("iqr"), F.bround(F.first("fence"), 3).alias("lower_fence"),
        flag(removed).alias("pixels_removed"), flag(F.col("removed_climatology")).alias("pixels_removed_climatology"), flag(F.col("removed_tukey")).alias("pixels_removed_tukey"), flag(F.col("removed_floor")).alias("pixels_removed_floor"),
        F.count("kept").alias("valid_pixels_after"), F.count(lst).alias("n_valid_before"),
    )
    return out.withColumn("fraction_removed", F.bround(F.try_divide(F.col("pixels_removed").cast("double"), F.col("n_valid_before").cast("double")), 6))


def quantile_composite(df: DataFrame, key: str, value: str, points: tuple = (0.15, 0.25, 0.5, 0.75, 0.85), least: int = 5) -> DataFrame:
    """Exact quantiles by key, their interquartile range and the count; null below least values."""
    q = matched(df.groupBy(key).agg(F.count(value).alias("n_valid")), quantiles(df, value, list(points), key), [key])
    enough = F.col("n_valid") >= least
    cols = [F.when(enough, F.col("q")[i]).alias(f"p{round(100 * p)}") for i, p in enumerate(points)]
    out = q.select(key, "n_valid", *cols)
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))
