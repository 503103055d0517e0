"""Queries without SQL against numpy on the driver's tables."""

import math
import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from hoarfrost.operators import models as model_ops
from hoarfrost.operators import trees
from hoarfrost.plans import views as v
from hoarfrost.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def terms(doy):
    w = 2 * np.pi / 365 * np.asarray(doy, float)
    return np.stack([np.ones_like(w), np.cos(w), np.sin(w), np.cos(2 * w), np.sin(2 * w)], axis=-1)


def test_harmonic_regression(spark):
    obs = {}
    for r in v.obs(spark, SF).collect():
        obs.setdefault(r.entity, []).append((r.d.timetuple().tm_yday, r.tmin))
    centers = {r.week_num: r.center_doy for r in QUERIES["frost_week_calendar"](spark, SF).collect()}
    got = QUERIES["harmonic_regression"](spark, SF).collect()
    assert len(got) == 39 * len(obs)
    for entity, rows in obs.items():
        doy, y = map(np.array, zip(*rows))
        beta = np.linalg.lstsq(terms(doy), y, rcond=None)[0]
        rest = y - terms(doy) @ beta
        n = len(y)
        sigma = math.sqrt((rest**2).sum() / max(1, n - min(5, max(1, n - 1))))
        for r in (r for r in got if r.entity == entity):
            mu = float(terms(centers[r.week_num]) @ beta)
            p = 0.5 * (1 + math.erf(-mu / sigma / math.sqrt(2)))
            assert abs(r.mu - mu) < 2e-6 and abs(r.sigma - sigma) < 2e-6 and abs(r.frost_prob - p) < 2e-6


def test_spatial_design(spark):
    got = QUERIES["spatial_design"](spark, SF).collect()
    ids = {(r.row, r.col) for r in got}
    z = {(r.row, r.col): r.z for r in v.grid(spark, SF).collect()}
    assert len(ids) == len(got) > 20 and ids <= set(z)
    assert {min(z, key=lambda k: (z[k], k)), max(z, key=lambda k: (z[k], [-x for x in k]))} <= ids
    extremes = {k for k in ids if sum((k[0] - q[0]) ** 2 + (k[1] - q[1]) ** 2 < 25 for q in ids) > 1}
    assert len(extremes) <= 8  # only the extremes may come closer than 500 m to others


def boosted_by_hand(rows, what, cuts):
    """What plain rounds of grow() predict for rows (a dict of columns), learnt from all of them."""
    x = np.stack([trees.bins_of(np.array(rows[f], float), np.array(c)) for f, c in zip(what.features, cuts)], axis=1)
    y = np.array(rows[what.target], float)
    now = np.full(len(y), y.mean())
    for _ in range(what.rounds):
        nodes, leaf = trees.grow(x, y - now, np.ones(len(y), np.uint8), what.depth, what.leaf)
        now = now + what.rate * nodes["value"].to_numpy()[leaf]
    return now


@pytest.mark.parametrize("name", ["gbt_frost_model", "mu_sigma_model"])
def test_boosted_queries_against_plain_rounds(spark, monkeypatch, name):
    """The models of the queries predict what plain rounds on the same rows do, and the probabilities follow from it."""
    seen, fit = [], model_ops.fit
    monkeypatch.setattr(model_ops, "fit", lambda df, what: seen.append((df, what, fit(df, what))) or seen[-1][2])
    got = QUERIES[name](spark, SF).collect()
    by = {}
    for df, what, model in seen:
        found = model.transform(df).toPandas()
        want = boosted_by_hand(found, what, model.cuts)
        # Rounding of targets may turn a tie between splits, so nearly all rows have to agree.
        assert (np.abs(found["predicted"].to_numpy() - want) < 1e-6).mean() > 0.99 and np.corrcoef(want, found[what.target])[0, 1] > 0.5
        found["by_hand"] = want
        by[what.target] = found.set_index(["entity", "week_num"])
    assert all(0 <= r.frost_prob <= 1 for r in got)
    if name == "gbt_frost_model":
        weeks = {(r.entity, r.week_num) for r in got}
        assert len(got) == 3 * len(weeks) and {r.anomaly for r in got} == {-1.0, 0.0, 1.0}
        assert np.mean([r.frost_prob for r in got if r.anomaly < 0]) >= np.mean([r.frost_prob for r in got if r.anomaly > 0]) - 0.05
    else:
        close = [abs(r.frost_prob - 0.5 * (1 + math.erf((0 - by["mu"]["by_hand"][r.entity, r.week_num]) / max(math.exp(by["ls"]["by_hand"][r.entity, r.week_num]), 0.01) / math.sqrt(2)))) < 1e-5 for r in got]
        assert np.mean(close) > 0.98


def test_train_and_evaluate_against_plain_means(spark, monkeypatch):
    """Metrics of the held-out rows, worked out from the model's own predictions for them; no scene is on both sides."""
    seen, fit = [], model_ops.fit
    monkeypatch.setattr(model_ops, "fit", lambda df, what: seen.append((df, fit(df, trees.Forest(what.features, what.target, trees=10, depth=8)))) or seen[-1][1])
    (row,) = QUERIES["train_and_evaluate"](spark, SF).collect()
    learnt, model = seen[0]
    from hoarfrost.plans.workflows import training

    scenes = {r.scene for r in learnt.select("scene").distinct().collect()}
    rest = training(spark, SF).where(~F.col("scene").isin(*scenes)).withColumn("doy", F.dayofyear("d"))
    held = model.transform(rest).select("lst", "predicted").toPandas()
    e = held["predicted"] - held["lst"]
    assert row.n == len(held) > 100 and len(scenes) >= 3
    assert abs(row.rmse - math.sqrt((e**2).mean())) < 1e-9 and abs(row.mae - e.abs().mean()) < 1e-9 and abs(row.bias - e.mean()) < 1e-9
    assert abs(row.r2 - (1 - (e**2).mean() / held["lst"].var(ddof=0))) < 1e-9
