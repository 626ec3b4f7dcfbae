"""Quantiles per group are exact in groups of many distinct values, where a sketch alone is off."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from stayrate.functions.ordering import group_quantiles
from stayrate.operators import lifetime, weekly
from stayrate.params import Params

N = 60_000


def scattered(n, count):
    return [((i * 7919 + 13) % count) / 7 for i in range(n)]


def test_large_small_tied_and_empty_groups(spark):
    values = {"large": scattered(N, 59_999), "tied": [1.0] * 500 + [2.0] * 501, "two": [5.0, 3.0], "one": [4.0], "none": [None], None: [8.0, 9.0, 7.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double").repartition(9)
    for q, at in ((0.5, lambda n: (n + 1) // 2), (0.9, lambda n: n - n // 10)):
        got = {r["g"]: (r["x"], r["rows"]) for r in group_quantiles(rows, ["g"], "v", q, "x", F.count(F.lit(1)).alias("rows")).collect()}
        known = {g: sorted(v for v in vs if v is not None) for g, vs in values.items()}
        assert got == {g: (vs[at(len(vs)) - 1] if vs else None, len(values[g])) for g, vs in known.items()}


def test_city_benchmark_of_a_large_city(spark):
    # one city and period of very many riders
    rates = scattered(N, 59_999)
    riders = spark.createDataFrame([(str(i), r) for i, r in enumerate(rates)], "rider_id string, total_earnings double").withColumn("week", F.lit("w"))
    hours = riders.select("rider_id", "week", F.lit(1.0).alias("hours_worked"))
    row = weekly.city_benchmark(riders.withColumn("city_code", F.lit("c")), hours).first()
    assert row["city_median_earnings_per_hour"] == sorted(rates)[N // 2 - 1]
    assert row["city_avg_total_earnings"] == pytest.approx(sum(rates) / N)


def test_balance_flags_of_a_large_city(spark):
    balances = scattered(N, 59_999)
    rows = spark.createDataFrame([(str(i), b) for i, b in enumerate(balances)], "courier_id string, cash_balance double")
    orders = spark.createDataFrame(
        [], "courier_id string, order_date date, order_id bigint, earnings double, is_stacked boolean, is_rush_bonus boolean, "
        "is_bad_weather boolean, is_reassigned boolean, is_undelivered boolean, is_failed boolean, fail_reason string, total_distance_km double, "
        "start_to_pickup_distance_km double, pickup_to_delivery_distance_km double, delivery_time_minutes double, waiting_time_pickup_minutes double, "
        "waiting_time_delivery_minutes double, batch_number double",
    )
    p = Params(as_of=date(2001, 8, 1), start=date(1995, 1, 1))
    flagged = lifetime.balance_features(orders, rows, rows.select("courier_id", F.lit("c").alias("city")), p)
    limit = sorted(balances)[N - N // 10 - 1]
    assert flagged.agg(F.sum("high_cash_balance_flag")).first()[0] == sum(b > limit for b in balances)
