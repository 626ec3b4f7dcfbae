"""The long rider x offset table, the wide feature table, deltas, RFM, early life and trends."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.common import (
    all_of,
    days_between,
    in_country,
    nz,
    period_start,
    present,
    safe_div,
    season,
    weekly_families,
)
from stayrate.functions.rules import DELTA_METRICS, LEAKAGE_COLUMNS, PER_ORDER_METRICS, WEEKLY_METRICS
from stayrate.operators.activity import completed_deliveries
from stayrate.params import Params


@dataclass(frozen=True)
class WeeklyInputs:
    """Relations that hang on (rider, week), each with at most one row per key."""

    deliveries: DataFrame
    shifts: DataFrame
    tickets: DataFrame
    violations: DataFrame
    gaps: DataFrame
    benchmark: DataFrame
    holidays: DataFrame


def combine_weekly(rider_periods: DataFrame, w: WeeklyInputs) -> DataFrame:
    """One row per rider and offset with every weekly measure.

    All rider inputs are hash-partitioned on (rider, week) by their own aggregation, so the joins
    after the first need no further shuffle of the growing left side.
    """

    def on_week(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("week", "feature_week")

    key = ["rider_id", "feature_week"]
    rows = (
        rider_periods.join(on_week(w.deliveries), key, "left")
        .join(on_week(w.shifts), key, "left")
        .join(on_week(w.tickets), key, "left")
        .join(on_week(w.violations), key, "left")
        .join(on_week(w.gaps), key, "left")
        .join(on_week(w.benchmark), ["city_code", "feature_week"], "left")
        .join(on_week(w.holidays), "feature_week", "left")
    )
    rate = safe_div("total_earnings", "hours_worked")
    median = F.col("city_median_earnings_per_hour")
    derived = {
        "city_code": F.coalesce("city_code", "city_name"),
        "earnings_per_hour": rate,
        "earnings_vs_city_median_abs": rate - median,
        "earnings_vs_city_median_ratio": safe_div(rate, median),
        "holiday_days_in_week": nz("holiday_days_in_week"),
        "season_name": season("feature_week"),
    }
    return rows.withColumns(derived).drop("city_name", "city_avg_total_earnings")


def rider_history(
    combined: DataFrame, country: str = "ALL", metrics: Sequence[str] = WEEKLY_METRICS
) -> DataFrame:
    """One row per rider with its periods as an array, newest first.

    A rider has one entry per offset by construction, so the array never exceeds the number of
    periods. Everything wide (pivot, deltas, RFM, panels) is then a projection without a shuffle.
    """
    fields = ["week_offset", "feature_week", "city_code", "zone_name", "vehicle_name", "season_name"]
    fields += [*metrics, "avg_total_distance_google"]
    entry = F.struct(*fields)
    rows = combined.groupBy("rider_id").agg(
        F.max("segment").alias("segment"),
        F.max("week_of_churn").alias("week_of_churn"),
        F.sort_array(F.collect_list(entry)).alias("h"),
    )
    return rows.withColumn("country_code", F.lit(country))


def at(metric: str, k: int, history: str = "h") -> Column:
    """Measure at offset k; NULL beyond the end."""
    return F.expr(f"get({history}.{metric}, {k})")


def stable_value(name: str) -> Column:
    """Value at offset 0, else the largest value of any offset."""
    return F.coalesce(at(name, 0), F.array_max(F.col(f"h.{name}")))


def wide_weeks(metrics: Sequence[str] = WEEKLY_METRICS, n: int = 8) -> list[Column]:
    return [at(m, k).alias(f"{m}_W{k}") for m in metrics for k in range(n)]


def period_deltas(metrics: Sequence[str] = DELTA_METRICS) -> list[Column]:
    """Newest minus previous and newest minus oldest period; NULL when either is missing."""
    out = []
    for m in metrics:
        out.append((at(m, 0) - at(m, 1)).alias(f"{m}_delta_W0_W1"))
        out.append((at(m, 0) - at(m, 7)).alias(f"{m}_delta_W0_W7"))
    return out


def _sum_of(values: Sequence[Column]) -> Column:
    total = nz(values[0])
    for v in values[1:]:
        total = total + nz(v)
    return total


def rfm() -> list[Column]:
    """Recency, frequency and money over four and eight periods, recent-to-previous ratios, pay per km."""

    def span(metric: str, lo: int, hi: int) -> Column:
        return _sum_of([at(metric, k) for k in range(lo, hi)])

    orders4, orders8 = span("total_orders_cpo", 0, 4), span("total_orders_cpo", 0, 8)
    pay4, pay8 = span("total_earnings", 0, 4), span("total_earnings", 0, 8)
    km = _sum_of([at("avg_total_distance_google", k) * at("total_orders_cpo", k) for k in range(8)])
    return [
        days_between(at("feature_week", 0), "last_order_date").alias("r_recency_days_at_anchor"),
        orders4.alias("f_orders_4w"),
        orders8.alias("f_orders_8w"),
        pay4.alias("m_earnings_4w"),
        pay8.alias("m_earnings_8w"),
        safe_div(pay4, span("total_earnings", 4, 8)).alias("m_earnings_recent4w_vs_prev4w_ratio"),
        safe_div(orders4, span("total_orders_cpo", 4, 8)).alias("f_orders_recent4w_vs_prev4w_ratio"),
        safe_div(pay8, km).alias("earnings_per_km_8w"),
    ]


EARLY_LIFE = (
    "days_registration_to_first_order",
    "orders_first_7d",
    "orders_first_30d",
    "compliance_events_first_30d",
    "first_week_earnings",
    "city_avg_earnings_first_week",
    "first_week_earnings_vs_city_avg_ratio",
)


def pivot_features(
    history: DataFrame, dates: DataFrame, sources: DataFrame, early: DataFrame
) -> DataFrame:
    """The wide table: 11 stable, 224 weekly, 1 season, 18 delta, 8 RFM and 7 early-life columns."""
    rows = (
        history.join(dates, "rider_id", "left")
        .join(sources.select("rider_id", "utm_source"), "rider_id", "left")
        .join(early.select("rider_id", *EARLY_LIFE), "rider_id", "left")
    )
    return rows.select(
        "rider_id",
        "country_code",
        *[stable_value(c).alias(c) for c in ("city_code", "zone_name", "vehicle_name")],
        "segment",
        "first_order_date",
        "last_order_date",
        "week_of_churn",
        at("feature_week", 0).alias("anchor_week"),
        "utm_source",
        *wide_weeks(),
        at("season_name", 0).alias("season_name_W0"),
        *period_deltas(),
        *rfm(),
        *EARLY_LIFE,
    )


def early_life(
    anchor: DataFrame,
    orders_nested: DataFrame,
    compliance: DataFrame,
    sources: DataFrame,
    delivery_weekly: DataFrame,
    benchmark: DataFrame,
    p: Params,
) -> DataFrame:
    """First days of newbies: time to the first order, orders, violations and pay against the city.

    Orders are reduced per rider and day before they meet the newbies. Violations meet them in an inner
    join, which Spark may split on both sides when one rider has very many; riders without any get 0.
    """
    first = anchor.where((F.col("segment") == "newbie") & F.col("first_order_date").isNotNull()).select(
        "rider_id", "first_order_date"
    )
    done = completed_deliveries(orders_nested, p)
    recent = None
    if p.early_lookback_days is not None:
        recent = F.col("created_date") >= F.date_sub(F.lit(p.as_of), F.lit(p.early_lookback_days))
    per_day = (
        done.where(all_of(recent, F.col("created_date") <= F.lit(p.as_of)))
        .groupBy("rider_id", F.to_date("rider_dropped_off_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    age = F.datediff("day", "first_order_date")
    orders = (
        first.join(per_day, "rider_id")
        .groupBy("rider_id")
        .agg(
            F.sum(F.when(age.between(0, 6), F.col("n")).otherwise(F.lit(0))).alias("orders_first_7d"),
            F.sum(F.when(age.between(0, 29), F.col("n")).otherwise(F.lit(0))).alias("orders_first_30d"),
        )
    )
    country = in_country(p.country)
    records = compliance if country is None else compliance.where(country)
    ids = (
        records.select(
            F.col("rider_id").cast("string").alias("rider_id"),
            F.to_date("created_date").alias("day"),
            F.explode_outer("violations").alias("v"),
        )
        .select("rider_id", "day", F.col("v.id").alias("id"))
        .distinct()
    )
    within = (F.col("f.rider_id") == F.col("c.rider_id")) & F.col("c.day").between(
        F.col("f.first_order_date"), F.date_add(F.col("f.first_order_date"), 29)
    )
    violations = (
        first.alias("f")
        .join(ids.alias("c"), within)
        .groupBy(F.col("f.rider_id").alias("rider_id"))
        .agg(F.countDistinct("c.id").alias("compliance_events_first_30d"))
    )
    first_week = first.select("rider_id", period_start("first_order_date", p.period).alias("week"))
    pay = (
        first_week.join(delivery_weekly.select("rider_id", "week", "city_code", "total_earnings"), ["rider_id", "week"], "left")
        .join(benchmark.select("city_code", "week", "city_avg_total_earnings"), ["city_code", "week"], "left")
        .select(
            "rider_id",
            F.col("total_earnings").alias("first_week_earnings"),
            F.col("city_avg_total_earnings").alias("city_avg_earnings_first_week"),
        )
    )
    return (
        first.join(sources, "rider_id", "left")
        .join(orders, "rider_id", "left")
        .join(violations, "rider_id", "left")
        .join(pay, "rider_id", "left")
        .select(
            "rider_id",
            "first_order_date",
            "registration_date",
            days_between("first_order_date", "registration_date").alias("days_registration_to_first_order"),
            "orders_first_7d",
            "orders_first_30d",
            nz("compliance_events_first_30d").alias("compliance_events_first_30d"),
            "first_week_earnings",
            "city_avg_earnings_first_week",
            safe_div("first_week_earnings", "city_avg_earnings_first_week").alias(
                "first_week_earnings_vs_city_avg_ratio"
            ),
        )
    )


def _number_sql(name: str) -> str:
    """SQL text: the column as a finite double, NULL where it is not one."""
    value = f"try_cast(`{name}` AS DOUBLE)"
    return f"CASE WHEN abs({value}) < double('Infinity') THEN {value} END"


def _with_numbers(df: DataFrame, sources: Sequence[str], derived: Sequence[tuple[str, str]]) -> DataFrame:
    """Add derived columns, given as (name, SQL over ``n_<column>``), with each source coerced once.

    Hundreds of columns are passed as text, which the driver builds much faster than column objects.
    """
    if not derived:
        return df
    numbers = [f"{_number_sql(c)} AS `n_{c}`" for c in sources]
    staged = df.selectExpr(*[f"`{c}`" for c in df.columns], *numbers)
    return staged.selectExpr(*[f"`{c}`" for c in df.columns], *[f"{sql} AS `{name}`" for name, sql in derived])


def per_order_features(df: DataFrame, numerators: Sequence[str] = PER_ORDER_METRICS) -> DataFrame:
    """Add each numerator divided by the orders of the same period."""
    have = set(df.columns)
    pairs = [
        (f"{m}_W{k}", f"total_orders_cpo_W{k}", f"{m}_per_order_W{k}")
        for k in range(8)
        if f"total_orders_cpo_W{k}" in have
        for m in numerators
        if f"{m}_W{k}" in have
    ]
    used = sorted({c for num, den, _ in pairs for c in (num, den)})
    return _with_numbers(df, used, [(name, f"try_divide(`n_{num}`, `n_{den}`)") for num, den, name in pairs])


def slope_sql(series: Sequence[str]) -> str:
    """Least-squares slope over positions 0, 1, ... of the known values; needs at least three.

    Plain sums, so it stays one generated expression per row.
    """
    known = [f"int(`{c}` IS NOT NULL)" for c in series]
    value = [f"coalesce(`{c}`, 0D)" for c in series]

    def total(parts: Sequence[str], power: int = 0) -> str:
        return "(" + " + ".join(f"{x**power} * {v}" if power else v for x, v in enumerate(parts)) + ")"

    n, sx, sxx = total(known), total(known, 1), total(known, 2)
    sy, sxy = total(value), total(value, 1)
    return f"CASE WHEN {n} >= 3 THEN try_divide({n} * {sxy} - {sx} * {sy}, {n} * {sxx} - {sx} * {sx}) END"


def wow_trends(df: DataFrame, families: Sequence[str] | None = None) -> DataFrame:
    """Add adjacent differences, relative differences and the slope over time for every family."""
    have = set(df.columns)
    derived: list[tuple[str, str]] = []
    used: list[str] = []
    for fam in families if families is not None else weekly_families(df.columns):
        offsets = [k for k in range(8) if f"{fam}_W{k}" in have]
        used += [f"{fam}_W{k}" for k in offsets]
        for k in offsets:
            if k + 1 not in offsets:
                continue
            new, old = f"`n_{fam}_W{k}`", f"`n_{fam}_W{k + 1}`"
            derived.append((f"{fam}_wow_delta_W{k}_W{k + 1}", f"{new} - {old}"))
            derived.append((f"{fam}_wow_pct_change_W{k}_W{k + 1}", f"try_divide({new} - {old}, {old})"))
        if len(offsets) >= 3:
            derived.append((f"{fam}_trend_slope_8w", slope_sql([f"n_{fam}_W{k}" for k in reversed(offsets)])))
    return _with_numbers(df, used, derived)


def labelled_cross_section(wide: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Labels with the features of the same rider, outcome columns removed, ratios and trends added."""
    label = present(snapshot, ["is_churned", "churn"])
    if not label:
        raise ValueError("the snapshot needs an is_churned or churn column")
    side = snapshot.select(
        F.col("rider_id").cast("string").alias("rider_id"),
        F.coalesce(F.col(label[0]).try_cast("int"), F.lit(0)).alias("is_churned"),
        *present(snapshot, ["segment", "tenure_days"]),
    )
    clash = [c for c in wide.columns if c in side.columns and c != "rider_id"]
    feats = wide.withColumnsRenamed({c: f"{c}_feat" for c in clash})
    merged = side.join(feats, "rider_id", "left").drop(*LEAKAGE_COLUMNS)
    return wow_trends(per_order_features(merged))
