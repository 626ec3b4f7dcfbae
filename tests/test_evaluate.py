"""Metrics against brute force and pandas."""

import numpy as np
import pandas as pd
import pytest

from stayrate.operators import drift, evaluate


def make(spark, y, p):
    pdf = pd.DataFrame({"id": range(len(y)), "y": y, "p": p})
    return pdf, spark.createDataFrame(pdf)


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def ap(y, p):
    total, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = y[p >= t]
        recall = hit.sum() / y.sum()
        total += (recall - last) * hit.mean()
        last = recall
    return total


@pytest.fixture(scope="module")
def tied(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(400), 1)
    y = (rng.random(400) < 0.2 + 0.4 * p).astype(int)
    return make(spark, y, p)


def test_curve_metrics(tied):
    pdf, df = tied
    row = evaluate.score_metrics(df).first()
    y, p = pdf["y"].to_numpy(), pdf["p"].to_numpy()
    assert row["roc_auc"] == pytest.approx(auc(y, p))
    assert row["avg_precision"] == pytest.approx(ap(y, p))
    assert row["brier_score"] == pytest.approx(np.mean((p - y) ** 2))


@pytest.mark.parametrize("y,expected", [([0, 0, 0], (None, None)), ([1, 1, 1], (None, 1.0))])
def test_one_class(spark, y, expected):
    _, df = make(spark, y, [0.1, 0.2, 0.2])
    row = evaluate.score_metrics(df).first()
    assert (row["roc_auc"], row["avg_precision"]) == expected and row["brier_score"] is not None


def test_all_scores_equal(spark):
    _, df = make(spark, [1, 0, 1, 0], [0.5] * 4)
    assert evaluate.score_metrics(df).first()["roc_auc"] == 0.5
    rows = evaluate.calibration_table(df).collect()
    assert len(rows) == 1 and rows[0]["count"] == 4 and rows[0]["bin"] == 0


@pytest.mark.parametrize("seed", range(3))
def test_bins_match_qcut(spark, seed):
    rng = np.random.default_rng(seed)
    p = np.round(np.minimum(rng.exponential(0.3, 300), 1.0), 2)
    pdf, df = make(spark, rng.integers(0, 2, 300), p)
    want = pd.qcut(pdf["p"], 10, labels=False, duplicates="drop").value_counts().sort_index()
    got = evaluate.calibration_table(df).orderBy("bin").toPandas()
    assert got["bin"].tolist() == want.index.tolist() and got["count"].tolist() == want.tolist()
    ece = evaluate.expected_calibration_error(df).first()["ece"]
    assert ece == pytest.approx((got["count"] * got["calibration_gap"].abs()).sum() / 300)


def test_ranking_with_k_beyond_rows(spark, tied):
    _, small = make(spark, [1, 0, 1], [0.9, 0.8, 0.1])
    rows = {r["k"]: r for r in evaluate.ranking_at_k(small, [0, 2, 50]).collect()}
    assert [rows[k]["cohort_size"] for k in (0, 2, 50)] == [1, 2, 3]
    assert rows[50]["recall_at_k"] == 1.0 and rows[50]["lift_at_k"] == 1.0
    _, df = tied
    bounded = sorted(map(tuple, evaluate.ranking_at_k(df, [50, 300]).collect()))
    for k, size, hits, precision, *_ in bounded:
        assert precision * size == pytest.approx(hits) and k == size


def test_threshold_sizes_fall(tied):
    pdf, df = tied
    rows = sorted(map(tuple, evaluate.threshold_capacity(df).collect()))
    want = sorted({float(np.quantile(pdf["p"], q)) for q in evaluate.THRESHOLD_QUANTILES})
    assert [r[0] for r in rows] == pytest.approx(want)
    assert [r[1] for r in rows] == [int((pdf["p"] >= t).sum()) for t in want]


def test_report_counts(tied):
    pdf, df = tied
    r = evaluate.threshold_report(df, 0.5).first()
    pred = pdf["p"] >= 0.5
    assert (r["tp"], r["fp"]) == (int((pred & (pdf["y"] == 1)).sum()), int((pred & (pdf["y"] == 0)).sum()))
    f1 = {t: 2 * (pdf["y"][pdf["p"] >= t].sum()) / ((pdf["p"] >= t).sum() + pdf["y"].sum()) for t in set(pdf["p"])}
    assert r["f1_at_threshold"] == pytest.approx(max(f1.values()), abs=1e-6)


def test_small_segments_are_left_out(spark):
    rows = [(i, "big" if i < 12 else "small", i % 2, i / 20) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, segment string, y int, p double")
    assert [r["segment"] for r in evaluate.segment_report(df).collect()] == ["big"]


def test_drift_has_one_row_less_than_label_rates(spark):
    rows = [(w, float(i * w), None if w == 2 else 1.0, i % 2) for w in (1, 2, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "event_week int, a double, b double, is_churned int")
    moved = {r["event_week"]: r for r in drift.feature_drift(df, features=["a", "b"]).collect()}
    assert drift.label_rate(df).count() == 3 and set(moved) == {2, 3}
    assert moved[2]["feature_count_compared"] == 1 and moved[2]["feature_drift_mean_abs"] == 1.5


def test_importance_share(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "feature string, importance double")
    got = {r["feature"]: r["cumulative_importance"] for r in evaluate.importance_table(df).collect()}
    assert got == {"b": 0.75, "a": 1.0}
