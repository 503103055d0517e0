"""Readers of fixed-width and token files, and of names that carry fields."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

log = logging.getLogger(__name__)


def station_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Station metadata of fixed-width lines (columns 0-11, 12-20, 21-30, 31-37, 41-71)."""
    part = lambda a, n: F.trim(F.substring(value, a, n))
    out = lines.where(F.length(value) >= 85).select(part(1, 11).alias("station_id"), part(13, 8).try_cast("double").alias("lat"), part(22, 9).try_cast("double").alias("lon"), part(32, 6).try_cast("double").alias("elevation"), part(42, 30).alias("name"))
    return out.where("lat is not null and lon is not null")


def inventory_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Inventory of lines of blank-separated tokens: id, lat, lon, element, first and last year."""
    t = F.split(F.trim(value), r"\s+")
    out = lines.where(F.size(t) >= 6).select(t[0].alias("station_id"), t[3].alias("element"), t[4].try_cast("int").alias("first_year"), t[5].try_cast("int").alias("last_year"))
    return out.where("first_year is not null and last_year is not null")


def daily_lines(lines: DataFrame, value: str = "value", elements: tuple = ("TMIN", "TMAX"), since: int = 1991) -> DataFrame:
    """Monthly wide lines -> a row a day: id, date, element, value (tenths as units), qflag.

    31 slots of 8 signs follow 21 signs of head; -9999, blanks, days that the
    month doesn't have, other elements, earlier years and short lines go.
    """
    head = lines.where((F.length(value) >= 269) & F.substring(value, 18, 4).isin(*elements))
    year, month = F.substring(value, 12, 4).try_cast("int"), F.substring(value, 16, 2).try_cast("int")
    slot = lambda d: F.struct(d.alias("day"), F.trim(F.substr(F.col(value), 22 + (d - 1) * 8, F.lit(5))).alias("raw"), F.trim(F.substr(F.col(value), 28 + (d - 1) * 8, F.lit(1))).alias("qflag"))
    days = head.where(year >= since).select(F.substring(value, 1, 11).alias("station_id"), year.alias("y"), month.alias("m"), F.substring(value, 18, 4).alias("element"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(31)), slot)).alias("s"))
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", "y", "m", "s.day"), "yyyy-MM-dd")
    out = days.where("s.raw not in ('', '-9999')").select("station_id", date.alias("date"), "element", (F.col("s.raw").try_cast("int") / 10.0).alias("value"), F.col("s.qflag").alias("qflag"))
    return out.where("date is not null and value is not null")


def known(value: Column, nodata: float, near: float = 1e-8, share: float = 1e-5) -> Column:
    """value, or null where it is the no-data value or as close to it as rounding brings it, or NaN."""
    return F.when(~F.isnan(value) & (F.abs(value - nodata) > near + share * abs(nodata)), value)


def first_readable(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of some Parquet tables that is there."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(", ".join(paths))


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None with a warning if it isn't there."""
    try:
        return first_readable(spark, [path])
    except FileNotFoundError:
        log.warning("%s isn't there", path)
        return None


def daily_files(spark: SparkSession, paths: list[str], **more) -> DataFrame:
    """daily_lines() of many station files; those that aren't there are left out with a warning, and none at all give no rows."""
    there = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            there.append(path)
        else:
            log.warning("%s isn't there", path)
    return daily_lines(spark.read.text(there) if there else spark.createDataFrame([], "value string"), **more)


def julian_date(name: Column) -> Column:
    """Date of '.yyyyDDDT' within a name, or null."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"\.(\d{7})T", 1), F.lit("")), "yyyyDDD")


def stamp(name: Column) -> Column:
    """Timestamp of 'yyyymmddThhmmss' within a name, or null."""
    found = F.nullif(F.regexp_extract(name, r"(\d{8}T\d{6})", 1), F.lit(""))
    return F.try_to_timestamp(found, F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")


def granule(name: Column, tokens: int = 9) -> tuple[Column, Column]:
    """(granule, layer) of a name of tokens joined by _; fewer tokens: all and 'unknown'."""
    t = F.split(name, "_")
    more = F.size(t) > tokens
    return F.when(more, F.array_join(F.slice(t, 1, tokens), "_")).otherwise(name), F.when(more, F.array_join(F.slice(t, tokens + 1, F.greatest(F.size(t) - tokens, F.lit(1))), "_")).otherwise("unknown")
