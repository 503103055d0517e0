"""The driver's tables in the roles of station, scene and grid data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily minimum temperature by station: entity, d, tmin, n."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.groupBy("entity", "d").agg((F.min("o_totalprice") / 10000.0 - 20.0).alias("tmin"), F.count(F.lit(1)).alias("n"))


OBS = """v_obs AS (SELECT c_nationkey AS entity, CAST(o_orderdate AS DATE) AS d, min(o_totalprice) / 10000.0::DOUBLE - 20.0::DOUBLE AS tmin, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations: station_id, lat, lon, name, grp."""
    nation = table(spark, sf_dir, "nation")
    lat = 35.0 + F.col("n_nationkey") * 0.05
    lon = -83.2 + F.col("n_nationkey") * 0.04
    return nation.select(F.col("n_nationkey").alias("station_id"), lat.alias("lat"), lon.alias("lon"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("grp"))


STATION = """v_station AS (SELECT n_nationkey AS station_id, 35.0::DOUBLE + n_nationkey * 0.05::DOUBLE AS lat, -83.2::DOUBLE + n_nationkey * 0.04::DOUBLE AS lon, n_name AS name, n_regionkey AS grp FROM nation)"""


def long_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in long form: event_id, entity, ts, d, element (TMIN or TMAX), value, k (flag bits)."""
    e = table(spark, sf_dir, "events")
    element = F.when(F.col("event_type").isin("click", "view"), "TMIN").otherwise("TMAX")
    return e.select("event_id", F.col("user_id").alias("entity"), "ts", F.col("ts").cast("date").alias("d"), element.alias("element"), (F.col("value") - 40.0).alias("value"), F.get_json_object("props", "$.k").cast("int").alias("k"))


LONG = """v_long AS (SELECT event_id, user_id AS entity, ts, CAST(ts AS DATE) AS d, CASE WHEN event_type IN ('click', 'view') THEN 'TMIN' ELSE 'TMAX' END AS element, value - 40.0::DOUBLE AS value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene pixels: scene, pixel, lst, base, d."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    joined = li.join(part, li.l_partkey == part.p_partkey)
    return joined.select(F.col("l_suppkey").alias("scene"), F.col("l_partkey").alias("pixel"), (F.col("l_extendedprice") / 1000.0).alias("lst"), (F.col("p_retailprice") / 100.0).alias("base"), F.col("l_shipdate").cast("date").alias("d"))


SCENE = """v_scene AS (SELECT l_suppkey AS scene, l_partkey AS pixel, l_extendedprice / 1000.0::DOUBLE AS lst, p_retailprice / 100.0::DOUBLE AS base, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid in long form: row, col, z."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "z")).select("row", "col", (F.col("z").cast("double") * 100.0 + 500.0).alias("z"))


GRID = """v_grid AS (SELECT CAST(vec_id AS INTEGER) AS row, CAST(pos - 1 AS INTEGER) AS col, CAST(embedding[pos] AS DOUBLE) * 100.0::DOUBLE + 500.0::DOUBLE AS z
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings))"""


def holed(grid: DataFrame) -> DataFrame:
    """The grid with z unknown (null) from 515 on."""
    return grid.withColumn("z", F.when(F.col("z") < 515, F.col("z")))


HOLED = "v_hole AS (SELECT row, col, CASE WHEN z < 515 THEN z END AS z FROM v_grid)"


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body
