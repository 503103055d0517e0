import pytest

from hoarfrost.operators import models, training
from hoarfrost.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


class Reached(Exception):
    pass


def stop(*args, **kwargs):
    raise Reached(args, kwargs)


def stages_of(monkeypatch, spark, name):
    """The parameters that a query hands to its tree model, without fitting it."""
    monkeypatch.setattr(models, "fit", stop)
    with pytest.raises(Reached) as e:
        QUERIES[name](spark, SF)
    what = e.value.args[0][1]
    return what.depth, what.trees if hasattr(what, "trees") else (what.rounds, what.rate)


@pytest.mark.parametrize("name", ["rf_fit_predict", "rf_cross_validation", "rf_importance", "permutation_importance", "partial_dependence_1d", "partial_dependence_2d", "train_and_evaluate"])
def test_forests_are_whole(spark, monkeypatch, name):
    assert stages_of(monkeypatch, spark, name) == (25, 200)


@pytest.mark.parametrize("name", ["gbt_fit_predict", "gbt_frost_model", "mu_sigma_model"])
def test_boosting_is_whole(spark, monkeypatch, name):
    assert stages_of(monkeypatch, spark, name) == (6, (500, 0.05))


def test_folds_repeats_and_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(models, "fit", lambda *a: None)
    monkeypatch.setattr(models, "cross_validated", lambda df, what, group, target, folds=5: seen.update(folds=folds))
    monkeypatch.setattr(models, "permuted", lambda df, model, features, target, repeats=1: seen.update(repeats=repeats))
    QUERIES["rf_cross_validation"](spark, SF)
    QUERIES["permutation_importance"](spark, SF)
    monkeypatch.setattr(training, "assembled", lambda cells, scenes, climate, covariates, rows: seen.update(rows=rows) or stop())
    with pytest.raises(Reached):
        QUERIES["train_and_evaluate"](spark, SF)
    assert seen == {"folds": 5, "repeats": 5, "rows": 500_000}
