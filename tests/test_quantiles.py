"""Quantiles of large groups by brackets against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hoarfrost.operators import quantiles as q


def brute(values, share):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    if not v:
        return None
    p = share * (len(v) - 1)
    a, b = v[math.floor(p)], v[math.ceil(p)]
    return a if p == math.floor(p) else (math.ceil(p) - p) * a + (p - math.floor(p)) * b


SHARES = [0.0, 0.02, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("accuracy", [20_000, 50])
def test_groups_of_all_sizes(spark, monkeypatch, accuracy):
    """A group with most rows, one of a single value, ties, nulls and NaN, a null key."""
    monkeypatch.setattr(q, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    groups = {
        "hot": [rng.gauss(0, 1) for _ in range(6000)], "same": [2.5] * 900, "ties": [float(rng.randrange(5)) for _ in range(800)], None: [rng.random() for _ in range(700)],
        "small": [3.0, 1.0], "one": [7.0], "none": [None, None], "odd": [None] * 50 + [math.nan] * 300 + [float(k) for k in range(500)], "skew": [0.0] * 700 + [rng.random() * 1e9 for _ in range(300)],
    }
    rows = [(k, x) for k, v in groups.items() for x in v]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    got = {r.k: r.q for r in q.quantiles(df, "x", SHARES, "k", large=100).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        want = [brute(v, s) for s in SHARES]
        if want[0] is None:
            assert got[k] is None
        else:
            assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(got[k], want)), k


def test_the_whole_table(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.random(), 0.5]) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in values], "x double").repartition(3)
    for large in (100, 10**6):
        (row,) = q.quantiles(df, "x", [0.01, 0.37, 0.99], large=large).collect()
        assert row.q == [brute(values, s) for s in (0.01, 0.37, 0.99)]
    assert [r.q for r in q.quantiles(df.limit(0), "x", [0.5]).collect()] == [None]
    assert q.quantiles(df.withColumn("k", F.lit(1)).limit(0), "x", [0.5], "k").count() == 0
