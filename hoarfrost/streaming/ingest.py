"""Resumable ingestion and windowed statistics as Structured Streaming jobs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoarfrost.operators.series import newest
from hoarfrost.operators.storage import shared_dir


def observations(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once_each(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows whose key hasn't come within the watermark: repeated deliveries are dropped, and the state stays bounded."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, ts: str, value: str, keys: list[str], size: str = "14 days", late: str = "1 day", start: str = "3 days") -> DataFrame:
    """Least and largest value and count in fixed windows; rows later than the watermark are dropped."""
    w = F.window(ts, size, size, start)
    out = stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "low", "high", "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a key's rows without a pause of gap: start, end and count."""
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into Parquet in the shared folder (exactly once, by its checkpoint) and read it."""
    base = f"{shared_dir(stream.sparkSession)}/{name}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")


#: Parts of an upserted table, by the key's hash.
PARTS = 16


def upserts(stream: DataFrame, target: str, key: str, order: str, parts: int = PARTS) -> None:
    """Merge each batch into a Parquet table of one row a key, the newest by order.

    Rows are in parts by the key's hash; a batch rewrites the parts that it
    touches, beside the old ones, and a small table tells which version of each
    part holds. What the version before the last one alone needed is deleted,
    so disk stays within two versions of the parts that change.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        before = _versions(spark, target, number - 1)
        touched = [r["_part"] for r in rows.select("_part").distinct().collect()]  # parts at most
        old = [f"{target}/v{before[p]}/_part={p}" for p in touched if p in before]
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")))
        merged = newest(rows, key, order).repartition("_part")
        merged.write.mode("overwrite").partitionBy("_part").parquet(f"{target}/v{number}")  # the same batch again writes the same version
        now = before | {p: number for p in touched}
        _note(spark, f"{target}/m{number}", json.dumps(now))
        earlier = _versions(spark, target, number - 2)
        for p, v in earlier.items():
            if before.get(p) != v:
                _delete(spark, f"{target}/v{v}/_part={p}")
        _delete(spark, f"{target}/m{number - 2}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _note(spark: SparkSession, path: str, text: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def _versions(spark: SparkSession, target: str, number: int) -> dict[int, int]:
    """The version of each part as of a batch; none before the first. Written whole before the batch counts as done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/m{number}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if number < 0 or not fs.exists(path):
        return {}
    file = fs.open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    file.close()
    return {int(p): v for p, v in json.loads(text).items()}


def latest_version(spark: SparkSession, target: str) -> DataFrame:
    """The table as of the last batch that upserts() finished, by its commit log."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/checkpoint/commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()]
    return spark.read.parquet(*[f"{target}/v{v}/_part={p}" for p, v in _versions(spark, target, max(done)).items()])
