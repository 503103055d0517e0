"""Trees, forests, boosting and what is told of them against slow versions in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoarfrost.operators import models, trees


def slow_tree(x, y, w, depth, leaf):
    """The same tree, node by node (all features at each node): (feature, cut, left, right) or a mean."""
    n = sum(w)
    mean = sum(a * b for a, b in zip(y, w)) / n
    best = (1e-12 * max(1.0, n * mean * mean), None)
    if depth:
        for j in range(len(x[0])):
            for cut in range(trees.BINS - 1):
                left = [i for i in range(len(y)) if x[i][j] <= cut]
                nl = sum(w[i] for i in left)
                if nl < leaf or n - nl < leaf:
                    continue
                sl = sum(w[i] * y[i] for i in left)
                gain = sl * sl / nl + (n * mean - sl) ** 2 / (n - nl) - n * mean * mean
                if gain > best[0] * (1 + 1e-9) + 1e-12:
                    best = (gain, (j, cut))
    if best[1] is None:
        return mean
    j, cut = best[1]
    sides = [[i for i in range(len(y)) if (x[i][j] <= cut) == side and w[i]] for side in (True, False)]
    return (j, cut, *(slow_tree([x[i] for i in s], [y[i] for i in s], [w[i] for i in s], depth - 1, leaf) for s in sides))


def slow_value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def value_of(nodes, x):
    at = 0
    while nodes["feature"][at] >= 0:
        at = nodes["left"][at] + (x[nodes["feature"][at]] > nodes["cut"][at])
    return nodes["value"][at]


@pytest.mark.parametrize("seed", range(6))
def test_tree_against_plain_loops(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 90))
    x = rng.integers(0, rng.choice([2, 9, 64]), (n, 3)).astype(np.uint8)
    y = rng.normal(size=n).round(2)
    w = rng.integers(0, 3, n)
    w[0] = 1
    nodes, leaf = trees.grow(x, y, w, 4, int(rng.integers(1, 6)) if seed else 1)
    slow = slow_tree(x.tolist(), y.tolist(), w.tolist(), 4, 1) if not seed else None
    for i in range(n):
        if w[i]:
            assert abs(nodes["value"][leaf[i]] - value_of(nodes, x[i])) < 1e-12
        if slow is not None:
            assert abs(value_of(nodes, x[i]) - slow_value(slow, x[i])) < 1e-9


@pytest.mark.parametrize("leaf", [1, 4, 15])
def test_splits_are_the_best(leaf):
    rng = np.random.default_rng(leaf)
    x = rng.integers(0, 12, (70, 3)).astype(np.uint8)
    y = 2.0 * x[:, 1] + rng.normal(size=70)
    w = rng.integers(0, 3, 70)
    nodes, _ = trees.grow(x, y, w, 5, leaf)
    slow = slow_tree(x.tolist(), y.tolist(), w.tolist(), 5, leaf)
    for row in x:
        assert abs(value_of(nodes, row) - slow_value(slow, row)) < 1e-9
    assert (nodes["gain"] >= 0).all()


def frame(spark, n=400):
    rng = np.random.default_rng(7)
    rows = [(float(a), float(b), float(c), float(3 * a + (b > 0.5) + rng.normal(0, 0.1))) for a, b, c in rng.random((n, 3)).round(3)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double"), rows


def bins(model, row):
    return [int(np.searchsorted(c, v, "left")) for c, v in zip(model.cuts, row)]


def by_tree(model):
    t = model.table()
    return [p.reset_index(drop=True) for _, p in t.groupby("tree")]


def test_forest_is_the_mean_of_its_trees(spark):
    df, rows = frame(spark)
    model = models.fit(df, models.forest(["a", "b", "c"], "y", trees=9, depth=7, leaf=3))
    parts = by_tree(model)
    assert len(parts) == 9
    for r in model.transform(df).collect()[:60]:
        assert abs(r.predicted - np.mean([value_of(p, bins(model, (r.a, r.b, r.c))) for p in parts])) < 1e-9
    shares = np.zeros(3)
    for p in parts:
        gain = [p["gain"][p["feature"] == j].sum() for j in range(3)]
        shares += np.array(gain) / sum(gain)
    assert np.allclose(list(model.importances().values()), shares / 9) and abs(shares.sum() / 9 - 1) < 1e-9
    again = models.fit(df.repartition(5), models.forest(["a", "b", "c"], "y", trees=9, depth=7, leaf=3))
    assert again.table().equals(model.table())  # however the rows come


def test_boosting_against_plain_rounds(spark):
    df, rows = frame(spark, 200)
    model = models.fit(df, models.boosted(["a", "b", "c"], "y", rounds=6, depth=3, rate=0.3, leaf=5))
    x = [bins(model, r[:3]) for r in rows]
    y = np.array([r[3] for r in rows])
    now = np.full(len(y), y.mean())
    for _ in range(6):
        tree = slow_tree(x, (y - now).tolist(), [1] * len(y), 3, 5)
        now = now + 0.3 * np.array([slow_value(tree, v) for v in x])
    got = {(r.a, r.b, r.c, r.y): r.predicted for r in model.transform(df).collect()}
    assert all(abs(got[r] - p) < 1e-9 for r, p in zip(rows, now))


def test_permutation_and_dependence(spark):
    df, rows = frame(spark, 300)
    model = models.fit(df, models.forest(["a", "b", "c"], "y", trees=5, depth=5, leaf=5))
    parts = by_tree(model)
    predict = lambda v: np.mean([value_of(p, bins(model, v)) for p in parts])
    pd1 = {r.a: r.mean_predicted for r in models.partial_dependence(df, model, {"a": [0.2, 0.7]}).collect()}
    for a in (0.2, 0.7):
        assert abs(pd1[a] - np.mean([predict((a, b, c)) for _, b, c, _ in rows])) < 1e-9
    pd2 = {(r.a, r.b): r.mean_predicted for r in models.partial_dependence(df, model, {"a": [0.1], "b": [0.4, 0.6]}).collect()}
    assert all(abs(v - np.mean([predict((a, b, c)) for _, _, c, _ in rows])) < 1e-9 for (a, b), v in pd2.items()) and len(pd2) == 2
    rise = {(r.feature, r.repeat): r.rise for r in models.permuted(df, model, ["a", "b", "c"], "y", repeats=2).collect()}
    assert len(rise) == 6 and all(rise["a", r] > rise["b", r] > abs(rise["c", r]) for r in (0, 1))
    assert models.permuted(df.repartition(1), model, ["a"], "y", repeats=1).first().rise > 0.5  # not only within partitions
    # A constant feature can't matter, whatever is dealt.
    flat = df.withColumn("c", F.lit(0.5))
    assert all(abs(r.rise) < 1e-12 for r in models.permuted(flat, model, ["c"], "y", repeats=1).collect())


def test_odd_inputs(spark):
    none = spark.createDataFrame([], "a double, y double")
    model = models.fit(none, models.forest(["a"], "y", trees=2))
    assert [r.predicted for r in model.transform(spark.createDataFrame([(1.0,), (None,)], "a double")).collect()] == [0.0, 0.0]
    some = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0), (1.0, math.inf), (2.0, 3.0)], "a double, y double")
    assert [r.predicted for r in models.fit(some, models.boosted(["a"], "y", rounds=2)).transform(some).collect()] == [3.0] * 4
    one = spark.createDataFrame([(1.0, 7.0)], "a double, y double")
    assert models.fit(one, models.forest(["a"], "y", trees=20)).transform(one).first().predicted == 7.0  # whatever samples are empty


def shape(nodes, at=0):
    """A tree without its numbers of nodes."""
    f = int(nodes["feature"][at])
    if f < 0:
        return round(float(nodes["value"][at]), 12)
    left = int(nodes["left"][at])
    return f, int(nodes["cut"][at]), round(float(nodes["gain"][at]), 9), shape(nodes, left), shape(nodes, left + 1)


@pytest.mark.parametrize("local", [0, 40, 150])
def test_nodes_split_over_tasks_are_those_of_one_task(spark, monkeypatch, local):
    """All nodes, or the larger ones, by histograms of blocks; the rest in tasks: the same trees, and for a forest those that grow() gives for each sample."""
    df, rows = frame(spark, 300)
    forest, boosted = models.forest(["a", "b", "c"], "y", trees=7, depth=6, leaf=3), models.boosted(["a", "b", "c"], "y", rounds=7, depth=3, rate=0.3, leaf=5)
    want = [[shape(p) for p in by_tree(models.fit(df, what))] for what in (forest, boosted)]
    monkeypatch.setattr(trees, "LOCAL_ROWS", local)
    monkeypatch.setattr(trees, "KEEP", 3)
    monkeypatch.setattr(trees, "HISTOGRAM_BYTES", 1 << 17)
    got = [models.fit(df.repartition(5), what) for what in (forest, boosted)]
    assert [[shape(p) for p in by_tree(m)] for m in got] == want
    for m in got:
        for p in by_tree(m):
            assert sorted(p["node"]) == list(range(len(p)))  # numbered without gaps
    again = models.fit(df, forest)
    x = np.array([bins(again, r[:3]) for r in rows], np.uint8)
    h = {(r.a, r.b, r.c, r.y): r.h for r in df.withColumn("h", F.xxhash64("a", "b", "c", "y")).collect()}
    scale = 2.0 ** math.floor(51 - math.log2(max(abs(r[3]) for r in rows) * 600))
    weight = trees.copies(np.array([h[r] for r in rows]), 42, 3)
    alone, _ = trees.grow(x, np.round(np.array([r[3] for r in rows]) * scale), weight, 6, 3, forest.share, 42, 3, 1, scale)
    assert shape(alone) == want[0][3]


def test_samples_and_features_are_drawn_evenly():
    h = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 200_000)
    a, b = trees.copies(h, 42, 0), trees.copies(h, 42, 1)
    counts = np.bincount(a) / len(a)
    assert np.allclose(counts[:4], [math.exp(-1), math.exp(-1), math.exp(-1) / 2, math.exp(-1) / 6], atol=0.005) and abs(a.mean() - 1) < 0.01
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01
    may = trees.chosen(np.arange(1, 20_001), 42, 5, 6, 0.5)
    assert (may.sum(axis=1) == 3).all() and np.allclose(may.mean(axis=0), 0.5, atol=0.02)


def test_many_nodes_of_few_rows():
    """Splits from sorted rows are those of histograms."""
    rng = np.random.default_rng(3)
    x, y, w = rng.integers(0, 255, (3000, 3)).astype(np.uint8), rng.integers(-1000, 1000, 3000).astype(float), rng.integers(1, 4, 3000)
    node = np.sort(rng.integers(0, 40, 3000))
    total, whole = np.bincount(node, w, 40), np.bincount(node, w * y, 40)
    may = rng.random(40) < 0.8
    a, b = trees.Best(40), trees.Best(40)
    for j in range(3):
        cell = node * trees.BINS + x[:, j]
        trees.sparse_splits(a, j, cell, w.astype(float), w * y, total, whole, 5, may)
        trees.dense_splits(b, j, np.bincount(cell, w, 40 * trees.BINS).reshape(40, -1), np.bincount(cell, w * y, 40 * trees.BINS).reshape(40, -1), total, whole, 5, may)
    for c in ("gain", "feature", "cut", "n", "s"):
        assert (getattr(a, c)[may] == getattr(b, c)[may]).all()


@pytest.mark.parametrize("depth", [1, 6])
def test_rounds_on_the_lattice_are_those_on_cells(depth):
    r = np.random.default_rng(depth)
    x = np.unique(np.stack([r.integers(0, 5, 900), r.integers(0, 40, 900), r.integers(0, 1, 900), r.integers(0, 9, 900)], axis=1).astype(np.uint8), axis=0)
    n = r.integers(1, 30, len(x)).astype(float)
    y, scale = np.round(1024 * n * (x[:, 1] - 3.0 * x[:, 3] + r.normal(size=len(x)))) / 1024, 2.0**20
    what, left = trees.Boosting(tuple("abcd"), "y", rounds=25, depth=depth), y
    for nodes in trees.boxed_rounds(x, y, n, what, scale):
        other, leaf = trees.grow(x, None, n, depth, what.leaf, scale=scale, sums=np.round(left * scale))
        left = left - what.rate * other["value"].to_numpy()[leaf] * n
        assert nodes.equals(other)


def test_values_for_all_bins_are_those_of_the_trees(spark, monkeypatch):
    df, _ = frame(spark)
    model = models.fit(df, models.boosted(["a", "b"], "y", rounds=12))
    rows = df.unionByName(spark.createDataFrame([(None, float("nan"), 0.0, 0.0), (-1e9, 1e9, 0.0, 0.0)], df.schema))
    assert model._tabled() is not None
    tabled = [r["predicted"] for r in model.transform(rows).collect()]
    monkeypatch.setattr(trees, "LATTICE", 0)
    walked = trees.TreeModel(model.features, model.target, model.cuts, model.nodes, model.base, model.rate, model.trees)
    assert walked._tabled() is None
    assert tabled == pytest.approx([r["predicted"] for r in walked.transform(rows).collect()], rel=1e-12)


def test_nodes_come_to_the_driver_packed(spark, monkeypatch):
    df, _ = frame(spark)
    monkeypatch.setattr(trees, "PIECE", 5)
    model = models.fit(df, models.forest(["a", "b"], "y", trees=3, depth=5, leaf=9))
    rows = model.nodes.orderBy("tree", "node").toPandas()
    bare = trees.TreeModel(model.features, model.target, model.cuts, None, model.base, model.rate, model.trees)
    assert bare.table().equals(rows)
