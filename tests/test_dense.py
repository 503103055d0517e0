"""Dense points, wide rows and large strata against plain Python."""

import hashlib
import os
import random

import numpy as np
from pyspark.sql import functions as F

from hoarfrost.operators import grid, sampling, storage


def greedy(points, apart):
    """Taken in order, each if none taken before is nearer than apart; taken points are looked up by square."""
    taken, by = [], {}
    for k, x, y, o in sorted(points, key=lambda p: (p[3], p[0])):
        cx, cy = int(x // apart), int(y // apart)
        if all((x - u) ** 2 + (y - v) ** 2 >= apart * apart for i in (-1, 0, 1) for j in (-1, 0, 1) for u, v in by.get((cx + i, cy + j), ())):
            by.setdefault((cx, cy), []).append((x, y))
            taken.append(k)
    return taken


def test_a_hundred_thousand_points_in_a_square(spark):
    """All pairs would be 10 ** 10; a table of points and one of squares is all that is written."""
    rng = random.Random(3)
    points = [(i, rng.random() * 0.7, rng.random() * 0.7, rng.randrange(1000)) for i in range(100_000)] + [(200_000 + i, rng.random() * 30, rng.random() * 30, rng.randrange(1000)) for i in range(800)]
    df = spark.createDataFrame(points + [(-1, None, 1.0, 0)], "id long, x double, y double, o int")
    got = sorted(r.id for r in sampling.thinned(df, "id", "x", "y", "o", 1.0).select("id").collect())
    assert got == sorted(greedy(points, 1.0))
    lattice = [(i, float(i % 20), float(i // 20), -i) for i in range(400)]  # distances that are just apart stay
    got = sorted(r.id for r in sampling.thinned(spark.createDataFrame(lattice, "id long, x double, y double, o int"), "id", "x", "y", "o", 2.0).collect())
    assert got == sorted(greedy(lattice, 2.0))
    assert sampling.thinned(df.limit(0), "id", "x", "y", "o", 1.0).count() == 0


def test_nearest_places():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        n = int(rng.integers(1, 60))
        at, more = np.cumsum(rng.integers(1, 4, n)).astype(float), rng.integers(0, rng.choice([3, 40, 2000]), n).astype(float)
        more[rng.random(n) < rng.choice([0, 0.5, 1])] = np.nan
        d = (at[:, None] - at) ** 2 + np.where(np.isnan(more), np.inf, more)
        assert (grid.nearest_of(at, more) == np.where(np.isinf(d.min(1)), -1, d.argmin(1))).all()


def test_a_wide_row(spark):
    """200,000 cells in a row, of which all pairs would be 4 * 10 ** 10."""
    rng = random.Random(7)
    wide, targets = 200_000, {(rng.randrange(3), rng.randrange(200_000)) for _ in range(300)}
    cells = spark.range(3 * wide).select((F.col("id") / wide).cast("int").alias("row"), (F.col("id") % wide).cast("int").alias("col"))
    goal = spark.createDataFrame(sorted(targets), "row int, col int").withColumn("t", F.lit(True))
    out = grid.distances(cells.join(goal, ["row", "col"], "left").withColumn("z", F.coalesce("t", F.lit(False))).drop("t"), F.col("z"))
    some = out.where("col % 9973 = 0").collect()
    assert out.count() == 3 * wide and len(some) == 63
    for r in some:
        assert abs(r.distance**2 - min((r.row - i) ** 2 + (r.col - j) ** 2 for i, j in targets)) < 1e-6


def test_a_stratum_with_all_rows(spark):
    """Tasks cut a stratum to its first rows before they are shuffled."""
    rows = [(i, 0 if i < 5000 else i % 7) for i in range(5040)]
    df = spark.createDataFrame(rows, "id long, s int").repartition(6)
    draw = lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest()
    for n, cells in ((60, 20), (5, 20), (6000, 10)):
        each, by = max(1, n // cells), {}
        for i, s in sorted(rows, key=lambda r: draw(r[0])):
            by.setdefault(s, []).append(i)
        first = sorted((i for v in by.values() for i in v[:each]), key=draw)
        want = (first + sorted((i for v in by.values() for i in v[each:]), key=draw))[:n]
        out = sampling.stratified(df, ["s"], n, "id", cells=cells)
        assert sorted(r.id for r in out.collect()) == sorted(want)
    plan = sampling.stratified(df, ["s"], 60, "id", cells=20)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_folds_of_equal_keys_stay(spark):
    """Runs are cut through equal keys alike, however the rows come."""
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "k int, id int")
    one, other = ({r.id: r.fold for r in sampling.runs(part, "k", 7).collect()} for part in (df.repartition(1), df.repartition(5, "id")))
    assert one == other and sorted(one.values()) == sorted([f for f in range(7) for _ in range(15 if f < 2 else 14)])


def test_what_is_left_can_be_deleted(spark, monkeypatch):
    monkeypatch.setattr(storage, "_there", set())
    kept = storage.written(spark.range(3), "x")
    gone = storage.written(spark.range(3), "x")
    storage.forget(gone)
    assert kept.count() == 3 and storage.close(spark) == 1 and storage.close(spark) == 0
    assert not os.path.exists(kept._written_at.removeprefix("file:"))
