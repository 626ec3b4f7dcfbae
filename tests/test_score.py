"""Drivers, categories, playbook and correlation on literal rows."""

import pytest
from pyspark.sql import functions as F

from stayrate.functions import rules
from stayrate.operators import correlate, score
from stayrate.sources import tables


def test_contributions_handle_constant_null_and_direction(spark):
    rows = [("a", 1.0, 7, None), ("b", 3.0, 7, 2.0), ("c", 5.0, 7, 4.0)]
    df = spark.createDataFrame(rows, "rider_id string, total_earnings_W0 double, flat int, cdt_W0 double")
    got = {r["rider_id"]: r for r in score.contributions(df)[0].collect()}
    assert got["a"]["total_earnings_W0"] == pytest.approx(1.2247448) and got["c"]["total_earnings_W0"] < 0
    assert got["a"]["flat"] == 0.0 and got["a"]["cdt_W0"] == 0.0


def test_top_drivers_only_positive(spark):
    df = spark.createDataFrame([(2.0, -1.0, 3.0, 0.0)], "a double, b double, c double, d double")
    got = df.select(score.top_drivers(["a", "b", "c", "d"], 5).alias("t")).first()["t"]
    assert [(x["feature"], x["impact_score"]) for x in got] == [("c", 3.0), ("a", 2.0)]


def test_playbook_rows(spark):
    rows = [
        ("high", "RSAT score ", "x", "do", " LOW"),
        (None, "", "y", "call", None),
        ("a", "b", "c", "   ", "low"),
    ]
    df = spark.createDataFrame(rows, "`Impact ` string, Metrics string, `Reasons to churn` string, `Action plan` string, `Estimated cost of action plan` string")
    got = {r["action"]: r for r in tables.normalise_playbook(df).collect()}
    assert set(got) == {"do", "call"}
    assert got["do"]["owner"] == "Rider Support" and got["do"]["estimated_cost"] == "LOW"
    assert (got["call"]["impact"], got["call"]["metric"], got["call"]["owner"]) == ("Unknown", "Unknown", "City Ops")


def topics(text):
    return {t for t, parts in rules.TOPIC_KEYWORDS.items() if any(p in text.lower() for p in parts)}


def test_playbook_match_against_loops(spark):
    book = [
        (1, "increase", "Earnings", "r", "pay more", "low", "Finance"),
        (2, "x", "SLOT_GAP", "r", "open slots", "High", "Planning"),
        (3, "x", "slot", "r", "open slots", "medium", "Planning"),
        (4, "none", "none", "r", "talk", "", "City Ops"),
        (5, "x", "distance cdt", "r", "shorter trips", "low", "City Ops"),
        (6, "x", "hours", "r", "more hours", "Medium", "City Ops"),
    ]
    playbook = spark.createDataFrame(book, "row_no bigint, impact string, metric string, reason string, action string, estimated_cost string, owner string")
    cities = [("c1", ["Earnings Health"], ["slot_gap_mean_days_W0", "cdt_W1"]), ("c2", ["Context"], ["season"]), ("c3", [], [])]
    df = spark.createDataFrame(
        [(c, [(k, 1.0) for k in cats], [(f, 1.0) for f in feats]) for c, cats, feats in cities],
        "city string, dominant_categories array<struct<category:string,impact_score:double>>, city_top_feature_signals array<struct<feature:string,impact_score:double>>",
    )
    got = {r["city"]: [(x["action"], x["match_score"]) for x in r["playbook_candidates"]] for r in score.match_playbook(df, playbook).collect()}
    for city, cats, feats in cities:
        mine = topics(" ".join(cats)) | topics(" ".join(feats))
        scored = []
        for n, impact, metric, _, action, cost, _ in book:
            bonus = {"low": 0.5, "medium": 0.2}.get(cost.strip().lower(), 0.0)
            scored.append((len(mine & topics(f"{impact} {metric} {action}")) + bonus, n, action))
        scored.sort(key=lambda t: -t[0])
        want, seen = [], set()
        for s, _, action in scored:
            if action not in seen and len(want) < 5:
                seen.add(action)
                want.append((action, s))
        assert got[city] == want


def test_signals_from_json_text(spark):
    df = spark.createDataFrame(
        [("x", '[{"feature":"a","impact_score":1.5},{"feature":"b","impact_score":-1}]'), ("x", "not json"), ("x", '[{"feature":" a ","impact_score":1}]')],
        "city string, top_feature_contributions string",
    )
    assert [(r["feature"], r["impact_score"]) for r in score.city_signals(df, ["city"]).collect()] == [("a", 2.5)]


def test_city_share_rounds_half_to_even(spark):
    rows = [("c", f"r{i}", 0.9 if i < 1 else 0.1, i < 1) for i in range(400)]
    df = spark.createDataFrame(rows, "city string, rider_id string, churn_probability double, is_high_risk boolean")
    row = score.city_summary(df).first()
    assert row["high_risk_pct"] == 0.2 and row["predicted_fleet_30d"] == 399  # 0.25 per cent


def test_pearson_with_constants_and_nulls(spark):
    rows = [(1.0, 2.0, 5.0, 0), (2.0, None, 5.0, 1), (3.0, 6.0, 5.0, 1), (4.0, 9.0, 5.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, is_churned int")
    got = {r["feature"]: r["pearson_r"] for r in correlate.target_correlation(df, features=["a", "b", "flat"]).collect()}
    pdf = df.toPandas()
    assert got["a"] == pytest.approx(pdf["a"].corr(pdf["is_churned"])) and got["b"] == pytest.approx(pdf["b"].corr(pdf["is_churned"]))
    assert got["flat"] is None
    assert correlate.correlation_matrix(df, ["a", "b", "flat"]).count() == 9
    assert correlate.target_correlation(df.limit(1), features=["a"]).first()["pearson_r"] is None


def test_hot_country_top_share(spark):
    rows = [("hot" if i % 3 else "cold", f"r{i:04d}", (i % 50) / 50) for i in range(900)]
    df = spark.createDataFrame(rows, "country_code string, rider_id string, churn_probability double")
    top = score.top_fraction(df).groupBy("country_code").agg(F.count("*").alias("n")).collect()
    assert {r["country_code"]: r["n"] for r in top} == {"hot": 60, "cold": 30}


def test_unknown_columns_get_placeholders(spark):
    row = tables.located(spark.createDataFrame([("x",)], "city_name string")).first()
    assert (row["country_code"], row["city_code"]) == ("UNKNOWN", "x")
