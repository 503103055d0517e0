"""Days reach the held state summed up, not row by row."""

import datetime

from pyspark.sql import functions as F

from hoarfrost.streaming import held, ingest


def test_only_closed_days_reach_the_state(spark, tmp_path):
    rows = spark.range(5_000).select((F.lit(datetime.datetime(2024, 1, 1)) + F.make_interval(secs=F.col("id") * 100)).alias("ts"), F.lit(1).alias("k"), (F.col("id") % 97).alias("v"))
    rows.write.parquet(f"{tmp_path}/in")
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, held.ROCKSDB)
    try:
        q = held.recent_days(ingest.observations(spark, f"{tmp_path}/in", rows.schema), "k", "ts", "v", 2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(conf)
    assert {len(p["stateOperators"]) for p in q.recentProgress} == {2}  # the sums of days come before the held days
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("day").collect()
    assert [(r.day.day, r.n, r.n_held, r.low) for r in got] == [(d, 864, min(d, 2), 0.0) for d in (1, 2, 3, 4)]
