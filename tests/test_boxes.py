"""Trees, predictions and cuts from lattices of bins and counts of values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoarfrost.operators import models, trees
from hoarfrost.plans.catalogue import QUERIES


@pytest.mark.parametrize("seed", range(8))
def test_trees_of_boxes_are_those_of_rows(seed, monkeypatch):
    r = np.random.default_rng(seed)
    monkeypatch.setattr(trees, "LOOKED_UP", int(r.choice([1, 50, 1 << 15])))
    sizes, n = r.integers(1, 14, int(r.integers(1, 5))), int(r.integers(1, 3000))
    x = np.stack([r.integers(0, k, n) + r.integers(0, 200) for k in sizes], axis=1).astype(np.uint8)
    w, s = r.integers(1, 9, n).astype(np.uint32), r.integers(-(10**9), 10**9, n).astype(float)
    s[:: int(r.choice([1, 2, n]))] = 7.0  # ties
    for share, path, depth, leaf in ((1.0, 1, 25, 20), (0.5, 1, 25, 1), (0.5, 6, 3, 4)):
        one, _ = trees.grow(x, None, w, depth, leaf, share, 42, 5, path, 1024.0, s, False)
        assert trees.grow_in_box(x, s, w, depth, leaf, share, 42, 5, path, 1024.0).equals(one)


def grid_frame(spark, n=500):
    r = np.random.default_rng(11)
    rows = [(float(a), float(b), float(c), float(2 * a - b * c + e)) for a, b, c, e in zip(r.integers(0, 7, n), r.integers(0, 5, n), r.integers(0, 3, n), r.normal(0, 1, n).round(3))]
    return spark.createDataFrame(rows, "a double, b double, c double, y double"), rows


def test_a_large_model_is_worked_out_for_all_bins(spark, monkeypatch):
    """Its rows are neither written nor joined with predictions."""
    df, _ = grid_frame(spark)
    odd = df.unionByName(spark.createDataFrame([(None, float("nan"), 1e9, 0.0), (-1e9, 2.5, None, 0.0)], df.schema))
    model = models.fit(df, models.forest(["a", "b", "c"], "y", trees=9, depth=8, leaf=3))
    want = sorted((str(r.a), str(r.b), str(r.c), r.y, r.p) for r in odd.withColumn("p", model.predictor()).collect())
    for name, value in (("SHARED_NODES", 0), ("SLICE", 5)):
        monkeypatch.setattr(trees, name, value)
    bare = lambda: trees.TreeModel(model.features, model.target, model.cuts, model.nodes, model.base, model.rate, model.trees)
    monkeypatch.setattr(trees.TreeModel, "by_key", None)
    tabled = [(*map(str, r[:3]), *r[3:]) for r in bare().transform(odd).select("a", "b", "c", "y", "predicted").collect()]
    monkeypatch.undo()
    monkeypatch.setattr(trees, "LATTICE", 0)
    walked = [(*map(str, r[:3]), *r[3:]) for r in bare().transform(odd).select("a", "b", "c", "y", "predicted").collect()]
    monkeypatch.setattr(trees, "SHARED_NODES", 0)
    joined = [(*map(str, r[:3]), *r[3:]) for r in bare().transform(odd).select("a", "b", "c", "y", "predicted").collect()]
    for got in (tabled, walked, joined):
        assert [r[:4] for r in sorted(got)] == [r[:4] for r in want]
        assert [r[4] for r in sorted(got)] == pytest.approx([r[4] for r in want], rel=1e-12)


def test_empty_sides_and_huge_values():
    """A cut outside a node's box leaves a side empty; running sums may run over."""
    feature, cut, left = np.array([0, -1, 0, -1, -1]), np.array([2, -1, 1, -1, -1]), np.array([1, -1, 3, -1, -1])
    got = trees.values_of([[feature, cut, left, np.array([0, 1e300, 0, 5.0, -1e300])]], [4, 2])
    assert (got == np.array([[1e300] * 2] * 3 + [[-1e300] * 2])).all()


def test_cuts_of_few_values_are_exact(spark, monkeypatch):
    """However rows come: the k-th cut is the value at k of 255 parts of the rows."""
    r = np.random.default_rng(2)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(r.integers(0, 1000, 4000) ** 2 / 7.0, r.integers(-3, 3, 4000), r.normal(size=4000))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    for part in (df.coalesce(1), df.repartition(7)):
        cuts, n, most = trees.cuts_of(part, ("a", "b"), "y")
        assert n == 4000 and most == max(abs(x[2]) for x in rows)
        for k, own in enumerate(cuts):
            values = sorted(x[k] for x in rows)
            assert own.tolist() == sorted({values[math.ceil(i * 4000 / 255) - 1] for i in range(1, 255)})
    monkeypatch.setattr(trees, "FEW", 100)
    many, _, _ = trees.cuts_of(df.repartition(7), ("a", "b"), "y")
    assert many[1].tolist() == cuts[1].tolist() and 200 < len(many[0]) <= 254
    sizes, real = [], trees.forget  # no task counts more values than that, though each of many partitions has few
    monkeypatch.setattr(trees, "forget", lambda df: sizes.append(df.count()) or real(df))
    small, _, _ = trees.cuts_of(df.repartition(60), ("a", "b"), "y")
    assert sizes[0] > 1000 and small[1].tolist() == cuts[1].tolist()
    assert small[0].tolist() == sorted(set(df.agg(F.percentile_approx("a", [i / 255 for i in range(1, 255)], 100_000)).first()[0]))
    assert [len(c) for c in trees.cuts_of(df.limit(0), ("a", "b"), "y")[0]] == [0, 0]


def test_folds_are_those_of_single_models(spark):
    df, _ = grid_frame(spark)
    df = df.withColumn("g", (F.col("a") * 5 + F.col("b")).cast("int"))
    what = lambda: models.forest(["a", "b", "c"], "y", trees=4, depth=5, leaf=5)
    dealt = models.group_folds(df, "g", 3)
    for r in models.cross_validated(df, what, "g", "y", 3).collect():
        model = models.fit(dealt.where(F.col("fold") != r.fold), what())
        one = models.metrics(model.transform(dealt.where(F.col("fold") == r.fold)), "y", "predicted").first()
        assert (r.n, r.rmse, r.bias) == (one.n, pytest.approx(one.rmse, rel=1e-9), pytest.approx(one.bias, rel=1e-9))


def slow_rises(spark, df, model, features, repeats):
    """Rises of the squared error with rows and draws as permuted() has them, row by row."""
    trees_of = [p.reset_index(drop=True) for _, p in model.table().groupby("tree")]

    def value(t, x):
        at = 0
        while t["feature"][at] >= 0:
            at = t["left"][at] + (x[t["feature"][at]] > t["cut"][at])
        return t["value"][at]

    def predict(r):
        x = [int(np.searchsorted(c, v, "left")) for c, v in zip(model.cuts, r)]
        return model.base + model.rate * sum(value(t, x) for t in trees_of)

    rows = df.withColumn("i", F.monotonically_increasing_id()).select("*", *[F.xxhash64("i", F.lit(42 + r)).alias(f"d{r}") for r in range(repeats)]).collect()
    mse = lambda some: np.mean([(predict(x) - y) ** 2 for x, y in some if y is not None])
    plain, out = mse([(list(r[:3]), r.y) for r in rows]), {}
    for r in range(repeats):
        order = sorted(rows, key=lambda x: x[f"d{r}"])
        for f in features:
            k = "abc".index(f)
            out[f, r] = mse([([b[j] if j == k else a[j] for j in range(3)], a.y) for a, b in zip(order, order[-1:] + order[:-1])]) - plain
    return out


def test_rises_are_those_of_rows_in_order(spark, monkeypatch):
    """Through partitions and their edges, empty ones and rows without a target too, by looked-up and by joined predictions."""
    df, _ = grid_frame(spark, 150)
    df = df.unionByName(spark.createDataFrame([(1.0, 1.0, 1.0, None), (2.0, 0.0, 2.0, None)], df.schema)).coalesce(1)
    model = models.fit(df, models.forest(["a", "b", "c"], "y", trees=3, depth=4, leaf=5))
    model.table()
    want = slow_rises(spark, df, model, ["a", "c"], 2)
    for lattice, parts in ((1 << 21, "4"), (1 << 21, "300"), (0, "7")):
        monkeypatch.setattr(trees, "LATTICE", lattice)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        bare = trees.TreeModel(model.features, model.target, model.cuts, model.nodes, model.base, model.rate, model.trees)
        got = {(r.feature, r.repeat): r.rise for r in models.permuted(df, bare, ["a", "c"], "y", repeats=2).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert models.permuted(df.limit(0), model, ["a"], "y", repeats=1).count() == 0


def test_rows_dealt_anew_are_moved_as_bins(spark, monkeypatch):
    """What is written: bins, targets and numbers once, sums of tasks, and the errors; no table of rows for each feature and repeat."""
    df, _ = grid_frame(spark)
    model = models.fit(df, models.forest(["a", "b", "c"], "y", trees=3, depth=4, leaf=5))
    model._tabled()
    seen, real = [], trees.written
    keep = lambda df, name, **more: seen.append((name, out := real(df, name, **more))) or out
    monkeypatch.setattr(trees, "written", keep)
    monkeypatch.setattr(models, "written", keep)
    assert models.permuted(df, model, ["a", "b", "c"], "y", repeats=3).count() == 9
    counts = {name: out.count() for name, out in seen}
    assert [n for n, _ in seen] == ["rows", "scored", "errors"] and counts["rows"] == 500 and counts["scored"] < 3 * 4 * (3 + 1) * 3


def test_dependence_is_over_all_rows(spark, monkeypatch):
    """12,000 rows, none left out; by looked-up, walked and joined predictions; and where no other feature is left."""
    df = spark.range(12_000).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") / 60).cast("int").cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * F.when(F.col("b") > 100, 1.0).otherwise(3.0))
    model = models.fit(df, models.forest(["a", "b"], "y", trees=4, depth=6, leaf=20))
    want = {a: model.transform(df.withColumn("a", F.lit(a))).agg(F.avg("predicted")).first()[0] for a in (3.0, 50.0)}
    for name, value in (("LATTICE", trees.LATTICE), ("LATTICE", 0), ("SHARED_NODES", 0)):
        monkeypatch.setattr(trees, name, value)
        bare = trees.TreeModel(model.features, model.target, model.cuts, model.nodes, model.base, model.rate, model.trees)
        got = {r.a: r.mean_predicted for r in models.partial_dependence(df, bare, {"a": [3.0, 50.0]}).collect()}
        assert got == {a: pytest.approx(v, rel=1e-12) for a, v in want.items()}
    both = models.partial_dependence(df, model, {"a": [3.0], "b": [7.0, 150.0]}).collect()
    alone = {r.b: r.predicted for r in model.transform(spark.createDataFrame([(3.0, 7.0), (3.0, 150.0)], "a double, b double")).collect()}
    assert {r.b: r.mean_predicted for r in both} == {b: pytest.approx(v, rel=1e-12) for b, v in alone.items()}


@pytest.mark.parametrize("name", ["rf_importance", "partial_dependence_1d", "partial_dependence_2d"])
def test_rows_are_joined_once(spark, monkeypatch, name):
    """Passes of a fit read what was written, not the join anew."""

    class Reached(Exception):
        pass

    def stop(df, what):
        raise Reached(df)

    monkeypatch.setattr(models, "fit", stop)
    with pytest.raises(Reached) as e:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "Join" not in e.value.args[0]._jdf.queryExecution().optimizedPlan().toString()
