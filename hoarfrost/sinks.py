"""Writers: partitioned tables, maps by week, formatted CSV, JSON records, models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoarfrost.operators.trees import TreeModel


def table(df: DataFrame, path: str, by: list[str] | None = None, rows_a_file: int = 0, codec: str = "zstd") -> None:
    """Parquet, in folders by the given columns; rows of a folder are brought together first, in as many files as they need."""
    if by:
        df = df.repartition(*[F.col(c) for c in by], F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(16))) if len(df.columns) > len(by) else df
    w = df.write.mode("overwrite").option("compression", codec)
    if rows_a_file:
        w = w.option("maxRecordsPerFile", rows_a_file)
    (w.partitionBy(*by) if by else w).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def weekly_maps(df: DataFrame, path: str, weeks: list[int], value: str = "frost_prob") -> None:
    """A folder a week, and beside it one table with a column a week."""
    table(df.select("row", "col", "week_num", value), f"{path}/by_week", ["week_num"])
    wide = df.groupBy("row", "col").pivot("week_num", weeks).agg(F.first(value))
    table(wide.select("row", "col", *[F.col(str(w)).alias(f"week_{w:02d}") for w in weeks]), f"{path}/wide")


def csv(df: DataFrame, path: str, digits: dict[str, int]) -> None:
    """CSV with a header and fixed numbers of digits."""
    text = {c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{n}f", F.col(c).cast("double"))) for c, n in digits.items()}
    df.select(*[text[c].alias(c) if c in text else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def record(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON record."""
    fields = [F.lit(v).alias(k) if not isinstance(v, (list, dict)) else (F.array(*map(F.lit, v)) if isinstance(v, list) else F.create_map(*[F.lit(x) for kv in v.items() for x in kv])).alias(k) for k, v in values.items()]
    spark.range(1).select(*fields).coalesce(1).write.mode("overwrite").json(path)


def model(m: TreeModel, path: str) -> None:
    """A tree model: its nodes as Parquet, the rest as one JSON record."""
    spark = m.nodes.sparkSession
    m.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    text = json.dumps({"features": m.features, "target": m.target, "cuts": m.cuts, "base": m.base, "rate": m.rate})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> TreeModel:
    m = json.loads(spark.read.text(f"{path}/model").first()[0])
    return TreeModel(tuple(m["features"]), m["target"], tuple(map(tuple, m["cuts"])), spark.read.parquet(f"{path}/nodes"), m["base"], m["rate"])
