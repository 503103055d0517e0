"""Queries over files of the formats that stations and rasters come in, written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hoarfrost.operators.storage import shared_dir
from hoarfrost.sources import raster
from hoarfrost.sources import text as src

from . import views as v
from .registry import query
from .seasons import rounded


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT 'US' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS station_id, CASE WHEN o_custkey % 3 = 0 THEN 'TMAX' ELSE 'TMIN' END AS element, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year FROM orders GROUP BY o_custkey")
def inventory_file(spark, sf_dir):
    """An inventory of blank-separated tokens; short lines and those without years go."""
    years = v.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    line = F.format_string("US%09d %8.4f  %9.4f %s %d %d", "o_custkey", F.lit(35.5), F.lit(-82.25), F.when(F.col("o_custkey") % 3 == 0, "TMAX").otherwise("TMIN"), "a", "b")
    odd = years.select(F.when(F.col("o_custkey") % 2 == 0, "US1 35 -82 TMIN").otherwise("US1 35 -82 TMIN none 2000").alias("value"))
    path = folder(spark, "inventory")
    years.select(line.alias("value")).unionByName(odd).write.text(path)
    return src.inventory_lines(spark.read.text(path))


@query(v.with_(v.OBS, body="""SELECT 'USW' || lpad(CAST(entity AS VARCHAR), 8, '0') AS station_id, d AS date, 'TMIN' AS element, CAST(round(tmin * 10) AS INTEGER) / 10.0::DOUBLE AS value, CASE WHEN n = 1 THEN '' ELSE 'X' END AS qflag FROM v_obs WHERE day(d) % 13 <> 0"""))
def station_files(spark, sf_dir):
    """A folder of monthly wide lines for every station: flags, blanks, -9999 for days without a value, months of 28 to 31 days; stations without files are skipped."""
    obs = v.obs(spark, sf_dir).withColumn("day", F.dayofmonth("d"))
    number = F.format_string("%5d", F.round(F.col("tmin") * 10).cast("int"))
    slot = F.when(F.col("day") % 13 == 0, F.lit(" " * 8)).otherwise(F.concat(number, F.lit(" "), F.when(F.col("n") == 1, " ").otherwise("X"), F.lit("S")))
    months = obs.groupBy("entity", F.year("d").alias("y"), F.month("d").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("day", slot.alias("slot")))).alias("slots"))  # 31 days at most
    days = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(31)), lambda k: F.coalesce(F.try_element_at("slots", k), F.lit("-9999   "))), "")
    line = F.concat(F.format_string("USW%08d%04d%02dTMIN", "entity", "y", "m"), days)
    path = folder(spark, "stations")
    months.select("entity", line.alias("value")).repartition("entity").write.partitionBy("entity").text(path)
    known = [r[0] for r in v.table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # the stations: as many as nations
    return src.daily_files(spark, [f"{path}/entity={k}" for k in [*known, -1]])


@query(v.with_(v.GRID, v.HOLED, body="""SELECT 'scene.height' AS layer, row, col, CAST(CAST(z AS FLOAT) AS DOUBLE) AS value FROM v_hole WHERE row BETWEEN 20 AND 90 AND col BETWEEN 5 AND 40
UNION ALL SELECT 'scene.double', row, col, CAST(CAST(z * 2 AS FLOAT) AS DOUBLE) FROM v_hole WHERE row BETWEEN 20 AND 90 AND col BETWEEN 5 AND 40"""))
def raster_window(spark, sf_dir):
    """A raster of two named bands, written and read back in a window, with cells that aren't known."""
    cells = v.holed(v.grid(spark, sf_dir))
    both = cells.select(F.lit("scene").alias("layer"), F.lit("height").alias("band"), "row", "col", F.col("z").alias("value")).unionByName(cells.select(F.lit("scene").alias("layer"), F.lit("double").alias("band"), "row", "col", (F.col("z") * 2).alias("value")))
    high, wide = cells.agg(F.max("row") + 1, F.max("col") + 1).first()
    path = folder(spark, "rasters")
    raster.write_rasters(both, path, high, wide, west=500_000.0, north=4e6, cell=100.0, nodata=-9999.0, bands=["height", "double"], epsg=32617)
    found = raster.read_cells(spark, path, window=(20, 90, 5, 40)).where(raster.inside(20, 90, 5, 40))
    return found


@query(v.with_(v.GRID, body="""SELECT row, col, round(CASE WHEN z < 505 THEN (z - lo) / (hi - lo) END, 6) AS z FROM v_grid CROSS JOIN (SELECT min(z) AS lo, max(z) AS hi FROM v_grid WHERE z < 505)"""))
def height_normalised(spark, sf_dir):
    """A height model whose no-data value is -9999 or near it: unknown, and the rest from 0 to 1."""
    stored = v.grid(spark, sf_dir).withColumn("z", F.when(F.col("z") < 505, F.col("z")).otherwise(F.when(F.col("row") % 2 == 0, -9999.0).otherwise(-9999.0000001)))
    known = src.known(F.col("z"), -9999.0)
    cells = stored.withColumn("z", known)
    ends = cells.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    out = cells.crossJoin(F.broadcast(ends))  # one row
    return rounded(out.select("row", "col", F.try_divide(F.col("z") - F.col("lo"), F.col("hi") - F.col("lo")).alias("z")), "z")
