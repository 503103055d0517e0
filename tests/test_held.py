"""The store of recent days over several batches: eviction, open days that go on, nulls."""

import datetime
import os
import random
import time

from pyspark.sql import functions as F

from hoarfrost.streaming import held, ingest


def test_days_are_held_and_evicted(spark, tmp_path):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = sorted((start + datetime.timedelta(hours=rng.randrange(24 * 20), seconds=rng.randrange(3600)), k, rng.choice([None, *map(float, range(9))])) for k in (1, 2, 3) for _ in range(60))
    rows += [(rows[-1][0], None, 1.0)]
    schema = "ts timestamp, k long, v double"
    source, step = f"{tmp_path}/in", -(-len(rows) // 4)
    os.makedirs(source)
    for i in range(4):  # one after the other, the last days of a file go on in the next
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(f"{tmp_path}/part{i}")
        (file,) = [f for f in os.listdir(f"{tmp_path}/part{i}") if f.endswith(".parquet")]
        os.rename(f"{tmp_path}/part{i}/{file}", f"{source}/{i}.parquet")
        os.utime(f"{source}/{i}.parquet", (time.time() - 1000 + i * 100,) * 2)
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, held.ROCKSDB)
    try:
        stream = ingest.observations(spark, source, spark.read.parquet(source).schema, files=1)
        q = held.recent_days(stream, "k", "ts", "v", 3, "2 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        assert len([p for p in q.recentProgress if p["numInputRows"]]) == 4  # batches
    finally:
        spark.conf.unset(conf)
    got = {(r.k, r.day): (r.low, r.n, r.n_held, r.mean_low, r.first_held) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    until, want = rows[-1][0] - datetime.timedelta(hours=2), {}
    for k in (1, 2, 3):
        days = {}
        for ts, key, value in rows:
            if key == k:
                days.setdefault(ts.date(), []).append(value)
        last = []
        for d in sorted(days):
            if datetime.datetime.combine(d, datetime.time()) + datetime.timedelta(days=1) <= until:
                low = min((x for x in days[d] if x is not None), default=None)
                last = [*last, (d, low)][-3:]
                some = [x for _, x in last if x is not None]
                want[k, d] = (low, len(days[d]), len(last), sum(some) / len(some) if some else None, last[0][0])
    assert got.keys() == want.keys() and len(want) > 40
    for key, w in want.items():
        g = got[key]
        assert g[:3] == w[:3] and g[4] == w[4] and (g[3] is None) == (w[3] is None) and (w[3] is None or abs(g[3] - w[3]) < 1e-9)
    assert spark.read.parquet(f"{tmp_path}/out").where(F.col("n_held") > 3).count() == 0
