"""Queries on samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoarfrost.operators import sampling as ops

from . import views as v
from .registry import query
from .seasons import rounded

EDGE = "(SELECT min(z) AS lo, max(z) AS hi FROM v_grid)"
STRATA = f"""v_str AS (SELECT row, col, z, CAST(least(floor((z - lo) / (hi - lo) * 20), 19) AS INTEGER) AS zbin, CAST(floor(col / 8.0) AS INTEGER) AS cbin FROM v_grid CROSS JOIN {EDGE})"""
CELLS = "md5(concat_ws('|', CAST(row AS VARCHAR), CAST(col AS VARCHAR), '42'))"


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey LIMIT 500")
def hash_sample_n(spark, sf_dir):
    return ops.sample_n(v.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 500, "o_orderkey")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey) AS i FROM orders)
WHERE i <= greatest(1, floor(n * 0.2::DOUBLE))""")
def per_scene_proportional_sample(spark, sf_dir):
    return ops.sample_per_group(v.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 0.2, "o_orderkey")


@query(v.with_(v.GRID, STRATA, body=f"""SELECT row, col, zbin, cbin FROM (SELECT *, {CELLS} AS h, row_number() OVER (PARTITION BY zbin, cbin ORDER BY {CELLS}, row, col) AS i FROM v_str) ORDER BY CASE WHEN i > 2 THEN 1 ELSE 0 END, h, row, col LIMIT 400"""))
def stratified_sample(spark, sf_dir):
    cells = ops.binned(v.grid(spark, sf_dir), "z", 20, "zbin").withColumn("cbin", F.floor(F.col("col") / 8).cast("int"))
    return ops.stratified(cells, ["zbin", "cbin"], 400, "row", "col").select("row", "col", "zbin", "cbin")


@query(v.with_(v.GRID, body="""SELECT row, col, round(z, 6) AS z FROM v_grid WHERE (row, col) IN (SELECT (row, col) FROM (SELECT row, col FROM v_grid ORDER BY z, row, col LIMIT 1) UNION SELECT (row, col) FROM (SELECT row, col FROM v_grid ORDER BY z DESC, row, col LIMIT 1)
UNION SELECT (row, col) FROM (SELECT row, col FROM v_grid ORDER BY abs(z - 500), row, col LIMIT 1) UNION SELECT (row, col) FROM (SELECT row, col FROM v_grid ORDER BY abs(z - 500) DESC, row, col LIMIT 1))"""))
def extreme_union(spark, sf_dir):
    cells = v.grid(spark, sf_dir).withColumn("a", F.abs(F.col("z") - 500))
    return rounded(ops.extremes(cells, ["z", "a"], "row", "col").select("row", "col", "z"), "z")


@query("""WITH g AS (SELECT l_suppkey, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(l_suppkey AS VARCHAR), '42')), l_suppkey) AS i FROM (SELECT DISTINCT l_suppkey FROM lineitem))
SELECT l_suppkey, i <= (SELECT ceil(count(*) * 0.3::DOUBLE) FROM g) AS is_test, count(*) AS n FROM lineitem JOIN g USING (l_suppkey) GROUP BY 1, 2""")
def group_shuffle_split(spark, sf_dir):
    split = ops.group_split(v.table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey")
    return split.groupBy("l_suppkey", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT list(l_suppkey ORDER BY n DESC, l_suppkey) AS keys, list({'load': [0::BIGINT], 'spots': [0], 'n': n} ORDER BY n DESC, l_suppkey) AS steps FROM g),
f AS (SELECT keys, list_reduce(list_prepend({'load': [0::BIGINT, 0, 0, 0, 0], 'spots': []::INTEGER[], 'n': 0::BIGINT}, steps), lambda acc, x: {'load': list_transform(acc.load, lambda v, i: v + CASE WHEN i = list_position(acc.load, list_min(acc.load)) THEN x.n ELSE 0 END),
'spots': list_append(acc.spots, list_position(acc.load, list_min(acc.load)) - 1), 'n': x.n}).spots AS spots FROM s), d AS (SELECT unnest(keys) AS l_suppkey, unnest(spots) AS fold FROM f)
SELECT CAST(fold AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_groups FROM d JOIN g USING (l_suppkey) GROUP BY 1""")
def group_kfold(spark, sf_dir):
    """Rows and groups of five folds of about the same size, dealt greedily."""
    folds = ops.group_folds(v.table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey")
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("n_groups"))


@query(v.with_(v.GRID, "v_c AS (SELECT [{'id': CAST(row AS BIGINT) * 64 + col, 'x': row::DOUBLE, 'y': col::DOUBLE}] AS c, z FROM v_grid WHERE z > 514)", body="""
SELECT k.id, k.x, k.y FROM (SELECT unnest(list_reduce(list(c ORDER BY z DESC, c[1].id), lambda acc, c: CASE WHEN len(list_filter(acc, lambda a: (a.x - c[1].x) * (a.x - c[1].x) + (a.y - c[1].y) * (a.y - c[1].y) < 36)) > 0 THEN acc ELSE list_concat(acc, c) END)) AS k FROM v_c)"""))
def min_separation_thinning(spark, sf_dir):
    """Cells at least 6 apart, taken greedily in the order of their height."""
    cells = v.grid(spark, sf_dir).where("z > 514").select((F.col("row").cast("long") * 64 + F.col("col")).alias("id"), F.col("row").cast("double").alias("x"), F.col("col").cast("double").alias("y"), (-F.col("z")).alias("rank"))
    return ops.thinned(cells, "id", "x", "y", "rank", 6.0).select("id", "x", "y")


@query("SELECT r_name AS name, 'region' AS kind FROM region UNION ALL SELECT n_name, 'nation' FROM nation EXCEPT SELECT n_name, 'nation' FROM nation WHERE n_regionkey = 1")
def union_except(spark, sf_dir):
    regions = v.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    nations = v.table(spark, sf_dir, "nation")
    names = lambda df: df.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return regions.unionByName(names(nations)).subtract(names(nations.where("n_regionkey = 1")))
