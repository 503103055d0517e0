"""Frost-season calendar, solar time and the conventions of satellite passes, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Months of a frost season, in its order.
FROST_MONTHS = (9, 10, 11, 12, 1, 2, 3, 4, 5)
SEASON_WEEKS, ASSIGNED_WEEKS = 39, 30


def frost_year(d: Column) -> Column:
    """The year in whose September the season began."""
    return F.when(F.month(d) >= 9, F.year(d)).otherwise(F.year(d) - 1)


def frost_doy(d: Column) -> Column:
    """Day of the season, from 0 on September 1 of common years (1 in leap years: day-of-year arithmetic)."""
    doy = F.dayofyear(d)
    return F.when(doy >= 244, doy - 244).otherwise(doy + 121)


def frost_week(d: Column, last: int = ASSIGNED_WEEKS) -> Column:
    """Week of the season from 1; 0 after week last."""
    week = (F.floor(frost_doy(d) / 7) + 1).cast("int")
    return F.when(week > last, 0).otherwise(week)


def week_calendar(spark: SparkSession, weeks: int = SEASON_WEEKS) -> DataFrame:
    """One row a week: week_num, start_doy, center_doy, end_doy, label."""
    wrap = lambda x: F.when(x > 365, x - 365).otherwise(x)
    start = F.col("id") * 7 + 244
    center = wrap(start + 3).cast("int")
    first = F.date_add(F.lit("2024-01-01").cast("date"), wrap(start).cast("int") - 1)
    return spark.range(weeks).select(
        (F.col("id") + 1).cast("int").alias("week_num"), wrap(start).cast("int").alias("start_doy"), center.alias("center_doy"), wrap(start + 6).cast("int").alias("end_doy"),
        F.concat(F.date_format(first, "MMM"), F.lit("-wk"), (F.floor((F.dayofmonth(first) - 1) / 7) + 1).cast("int").cast("string")).alias("label"),
    )


def climate_day(ts: Column) -> Column:
    """Day whose minimum a pass belongs to: passes from 12 UTC on count for the next day."""
    return F.when(F.hour(ts) >= 12, F.date_add(ts.cast("date"), 1)).otherwise(ts.cast("date"))


def sunrise_minutes(d: Column, lat: Column, lon: Column) -> Column:
    """Sunrise in minutes after midnight UTC: fractional-year series, zenith 90.833 degrees; may lie outside 0 to 1440."""
    g = F.lit(2 * math.pi / 365) * (F.dayofyear(d) - 1)
    equation = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    tilt = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    phi = F.radians(lat)
    x = F.lit(math.cos(math.radians(90.833))) / (F.cos(phi) * F.cos(tilt)) - F.tan(phi) * F.tan(tilt)
    angle = F.degrees(F.acos(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))))
    return 720 - 4 * (lon + angle) - equation


def sunrise_second(d: Column, lat: Column, lon: Column) -> Column:
    """Sunrise as seconds after midnight UTC, hours taken mod 24 and minutes cut."""
    minutes = sunrise_minutes(d, lat, lon)
    hour = F.floor(minutes / 60)
    return (F.pmod(hour, F.lit(24)) * 3600 + F.floor(minutes - hour * 60) * 60).cast("long")


def hours_until_sunrise(ts: Column, lat: Column, lon: Column) -> Column:
    """Hours to the next sunrise: today's if it is still to come, else tomorrow's; never negative."""
    day = ts.cast("date")
    now = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    today = sunrise_second(day, lat, lon)
    left = F.when(now < today, today - now).otherwise(86400 + sunrise_second(F.date_add(day, 1), lat, lon) - now)
    return F.greatest(left / 3600.0, F.lit(0.0))


def us_eastern_hour(ts: Column) -> Column:
    """Local hour of a UTC time with daylight saving from the second Sunday of March to the first of November, both at 02:00 UTC."""
    def sunday(month: int, nth: int) -> Column:
        first = F.make_date(F.year(ts), F.lit(month), F.lit(1))
        return F.date_add(first, F.pmod(F.lit(8) - F.dayofweek(first), F.lit(7)).cast("int") + 7 * (nth - 1))

    hours = lambda day: F.datediff(day, F.lit("1970-01-01").cast("date")) * 24
    now = hours(ts.cast("date")) + F.hour(ts)
    summer = (now >= hours(sunday(3, 2)) + 2) & (now < hours(sunday(11, 1)) + 2)
    return F.pmod(F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0 + F.when(summer, -4).otherwise(-5), F.lit(24))


def overpass_class(hour: Column) -> Column:
    """predawn [2, 6), morning [6, 10), daytime [10, 20), evening."""
    return F.when((hour >= 2) & (hour < 6), "predawn").when((hour >= 6) & (hour < 10), "morning").when((hour >= 10) & (hour < 20), "daytime").otherwise("evening")


def month_since_1960(n: Column) -> Column:
    """First day of the n-th month after January 1960."""
    return F.add_months(F.lit("1960-01-01").cast("date"), n)


def season_frost_year(season: Column, year: Column) -> Column:
    """Frost year of a season's forecast: fall Y is Y, spring Y is Y - 1."""
    return F.when(season == "fall", year).otherwise(year - 1)


def week_to_date(week: Column, season: Column) -> Column:
    """Date of a fractional week of the season that began in the year season: its centre, days cut."""
    return F.date_add(F.make_date(season, F.lit(9), F.lit(1)), F.floor((week - 1) * 7 + 3).cast("int"))
