"""The panel and model queries see all weekly families with their derived columns, and the models are the declared ones."""

import pytest

import __spark_entry__ as entry_points
from stayrate.functions.rules import WEEKLY_METRICS
from stayrate.operators import ml

QUERIES = entry_points.queries()
LAGS = {f"{m}_W{k}" for m in WEEKLY_METRICS for k in range(8)}


def agree(narrow, whole, keys):
    shared = sorted(set(narrow.columns) & set(whole.columns))
    pick = lambda df: sorted(map(str, df.select(*shared).collect()))
    assert set(keys) < set(shared) and pick(narrow) == pick(whole)


def test_forward_panel_all(spark, data):
    whole = QUERIES["forward_panel_all"](spark, data).persist()
    assert LAGS < set(whole.columns) and "total_earnings_per_order_W0" in whole.columns and len(whole.columns) > 300
    agree(QUERIES["forward_panel"](spark, data), whole, ["rider_id", "event_week", "is_churned", "hours_worked_W7"])


@pytest.mark.parametrize("name", ["per_order_all", "wow_trends_all", "labelled_cross_section_all"])
def test_wide_queries_take_all_families(spark, data, name):
    whole = QUERIES[name](spark, data)
    assert LAGS < set(whole.columns) and whole.count() > 0


def test_full_history_has_all_families_and_offsets(spark, data):
    whole = QUERIES["forward_panel_full_history_all"](spark, data)
    assert LAGS < set(whole.columns)
    per_rider = whole.groupBy("rider_id").count().agg({"count": "max"}).first()[0]
    assert per_rider > QUERIES["forward_panel_full_history"](spark, data).groupBy("rider_id").count().agg({"count": "max"}).first()[0]


class Stop(Exception):
    pass


@pytest.mark.parametrize("name", ["ml_train_score", "ml_importance", "rolling_backtest"])
def test_models_are_the_declared_ones(spark, data, monkeypatch, name):
    seen = {}

    def fit(train, test, candidates=None, label="is_churned"):
        seen.update(columns=train.columns, models=candidates or ml.candidate_models())
        raise Stop

    def backtest(rows, estimator, model_name, **options):
        seen.update(columns=rows.columns, models={model_name: estimator()})
        raise Stop

    monkeypatch.setattr(ml, "fit_candidates", fit)
    monkeypatch.setattr(ml, "rolling_backtest", backtest)
    with pytest.raises(Stop):
        QUERIES[name](spark, data)
    assert LAGS < set(seen["columns"]) and "total_earnings_per_order_W0" in seen["columns"]
    sizes = lambda m: {p.name: v for p, v in m.extractParamMap().items() if p.name in ("maxIter", "numTrees", "maxDepth")}
    declared = ml.candidate_models()
    assert {n: sizes(m) for n, m in seen["models"].items()} == {n: sizes(declared[n]) for n in seen["models"]}
    assert set(seen["models"]) == set(declared) or name != "ml_train_score"
