"""The registered model queries fit models of full size, in every fit."""

import pytest

from rainloom.catalog import models as catalog
from rainloom.catalog import queries
from rainloom.operators import models
from rainloom.operators.bagging import ForestSettings
from rainloom.operators.boosting import Settings

FOREST = dict(numTrees=200, maxDepth=15, minInstancesPerNode=1)
PHASE = dict(numTrees=300, maxDepth=12, minInstancesPerNode=5)


@pytest.mark.parametrize("name, kind, expected", [
    ("champion_test_metrics", "RandomForestClassifier", [FOREST]), ("rf_score", "RandomForestClassifier", [FOREST]),
    ("hurdle_amount", "RandomForestRegressor", [dict(numTrees=200, maxDepth=15)]),
    ("champion_on_forecast", "RandomForestClassifier", [FOREST, PHASE]),
])
def test_settings_of_every_fit(spark, monkeypatch, name, kind, expected):
    """Small forests are fitted in place of the asked ones, so that the flow runs to its end."""
    asked, real = [], getattr(models, kind)

    def small(**settings):
        asked.append({k: settings.get(k) for k in expected[0] if k in settings})
        return real(**{**settings, "numTrees": 3, "maxDepth": 3})

    monkeypatch.setattr(models, kind, small)
    monkeypatch.setattr(catalog, "regional", models.Grower(ForestSettings(3, 3, 20), "small", complete=True))
    assert queries()[name](spark, "/root/testdata/sf0.01").count() > 0
    assert asked and all(a in expected for a in asked) and all(e in asked for e in expected)


def test_settings_of_grown_models():
    assert catalog.fit_boosted.settings == Settings(300, 0.05, 31, 1.0, 20)
    assert catalog.regional.settings == ForestSettings(300, 12, 20, "bag")
    assert catalog.champions.settings == ForestSettings(200, 15, 1, "all")


@pytest.mark.parametrize("name", [
    "ensemble_score", "gbt_mos", "approach_comparison_with_model", "approaches_by_held_out_station", "loso_eval", "regional_training", "ensemble_training",
    "out_of_fold_scores", "retrain_with_ledger", "feature_importance_topk", "ablation_sets", "train_test_source_matrix",
])
def test_flows_run_to_their_end(spark, monkeypatch, name):
    """Every other model query with small settings."""
    from functools import partial

    monkeypatch.setattr(catalog, "fit_boosted", models.Grower(Settings(rounds=3), "small"))
    monkeypatch.setattr(catalog, "regional", models.Grower(ForestSettings(3, 3, 20), "small", complete=True))
    monkeypatch.setattr(catalog, "champions", models.Grower(ForestSettings(3, 3, 20, "all"), "small", complete=True))
    monkeypatch.setattr(catalog, "fit_forest", partial(models.fit_forest, trees=3, depth=3))
    assert queries()[name](spark, "/root/testdata/sf0.01").count() > 0
