"""Ordered scans over time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lagged(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """cols of the row before, as <col>_prev: the row, not the day, so a gap is bridged."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({f"{c}_prev": F.lag(c).over(w) for c in cols})


def gap_filled(df: DataFrame, key: str, index: str, value: str, least: int = 2) -> DataFrame:
    """Nulls of value filled by a line between the known neighbours by index, held at the ends; series with fewer than least known values stay."""
    before = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(index).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(index))
    x0, y0 = F.last(at, True).over(before), F.last(value, True).over(before)
    x1, y1 = F.first(at, True).over(after), F.first(value, True).over(after)
    out = df.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1, "_n": F.count(value).over(Window.partitionBy(key))})
    span = F.nullif(F.col("_x1") - F.col("_x0"), F.lit(0)).cast("double")
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col(index) - F.col("_x0")) / span
    filled = F.coalesce(F.col(value), line, F.col("_y0"), F.col("_y1"))
    return out.withColumn("filled", F.when(F.col("_n") >= least, filled).otherwise(F.col(value))).drop("_x0", "_y0", "_x1", "_y1", "_n")


def newest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by order: one aggregate over structs, no sort."""
    rest = [c for c in df.columns if c != key and c not in order]
    top = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_t"))
    return top.select(key, *[F.col("_t")[c].alias(c) for c in (*order, *rest)]).select(*df.columns)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new rows, the new one where both have the key."""
    both = old.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)), allowMissingColumns=True)
    return newest(both, key, "_g").drop("_g")


def every_nth(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Rows 1, n + 1, 2n + 1, ... of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).where((F.col("_i") - 1) % n == 0).drop("_i")


def median_row(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row in the middle of each key (of an even number the later one)."""
    w = Window.partitionBy(key)
    out = df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    return out.where(F.col("_i") == F.floor(F.col("_n") / 2) + 1).drop("_i", "_n")
