"""Queries that run as streams over what there is."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hoarfrost.operators.storage import shared_dir
from hoarfrost.streaming import held, ingest

from . import views as v
from .registry import query


def folder_of(spark, sf_dir, parts: int = 4):
    """The events, dealt into some files by time, as a source folder."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    e = v.table(spark, sf_dir, "events")
    e.withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(parts, "ts").write.parquet(path)
    return path, spark.read.parquet(path).schema


@query("""SELECT event_id, user_id, value FROM events""")
def stream_once_each(spark, sf_dir):
    """Every event once, though the source delivers all of them twice."""
    path, schema = folder_of(spark, sf_dir)
    spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
    spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
    rows = ingest.once_each(ingest.observations(spark, path + "-twice", schema), "event_id", "ts", "60 days")
    return ingest.drained(rows, f"once-{uuid.uuid4().hex}").select("event_id", "user_id", "value")


@query("""SELECT CAST(epoch(ws) AS BIGINT) AS start_s, event_type, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) AS n
FROM (SELECT *, TIMESTAMP '1970-01-04' + to_days(CAST(floor((epoch(ts) - 259200) / 1209600.0) * 14 AS INTEGER)) AS ws FROM events) WHERE ws + INTERVAL 14 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    """Fixed windows of 14 days that the watermark has passed."""
    path, schema = folder_of(spark, sf_dir)
    rows = ingest.drained(ingest.windowed(ingest.observations(spark, path, schema), "ts", "value", ["event_type"]), f"windows-{uuid.uuid4().hex}")
    return rows.select(F.unix_timestamp("window_start").alias("start_s"), "event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_upsert(spark, sf_dir):
    """The newest event of every user, merged batch by batch."""
    path, schema = folder_of(spark, sf_dir)
    target = f"{shared_dir(spark)}/inventory-{uuid.uuid4().hex}"
    rows = ingest.observations(spark, path, schema, files=2).select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "value")
    ingest.upserts(rows, target, "user_id", "at")
    return ingest.latest_version(spark, target).select("user_id", "event_id", "value")


@query("""SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM
(SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS brk FROM events))
GROUP BY user_id, g HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_sessions(spark, sf_dir):
    """Sessions of users, with pauses under 12 hours, that the watermark has passed."""
    path, schema = folder_of(spark, sf_dir)
    rows = ingest.drained(ingest.sessions(ingest.observations(spark, path, schema), "ts", "user_id", "12 hours"), f"sessions-{uuid.uuid4().hex}")
    return rows.select("user_id", F.unix_timestamp("session_start").alias("start_s"), "n")


@query("""SELECT user_id, day, low, n, CAST(least(3, row_number() OVER w) AS INTEGER) AS n_held, round(avg(low) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean_low, min(day) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS first_held
FROM (SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS low, count(*) AS n FROM events GROUP BY 1, 2) WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def stream_recent_days(spark, sf_dir):
    """Each day of a user that the watermark has passed, with the last three days held: older ones are evicted from the state."""
    path, schema = folder_of(spark, sf_dir)
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, held.ROCKSDB)
    try:
        rows = ingest.drained(held.recent_days(ingest.observations(spark, path, schema), "user_id", "ts", "value", 3), f"held-{uuid.uuid4().hex}")
    finally:
        spark.conf.set(conf, before) if before else spark.conf.unset(conf)
    return rows.withColumn("mean_low", F.round("mean_low", 6))
