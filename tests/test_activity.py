"""Snapshot, labels and gaps on literal rows."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd

from stayrate.operators import activity, features, weekly
from stayrate.params import Params

AS_OF = date(2026, 5, 13)  # a Wednesday
P = Params(as_of=AS_OF, start=date(2026, 1, 1))
ORDERS = (
    "country_code string, created_date date, deliveries array<struct<rider_id:string,delivery_status:string,"
    "is_primary:boolean,rider_dropped_off_at:timestamp_ntz>>"
)
SLOTS = "country_code string, rider_id string, created_date date, shift_start_at timestamp_ntz, shift_state string"


def ago(n):
    return AS_OF - timedelta(days=n)


def noon(d):
    return datetime(d.year, d.month, d.day, 12)


def orders(spark, rows):
    return spark.createDataFrame(
        [("PL", d, [(r, s, pr, noon(d))]) for r, d, s, pr in rows] + [("PL", ago(3), [])], ORDERS
    )


def slots(spark, rows):
    return spark.createDataFrame([("PL", r, d, noon(d), s) for r, d, s in rows], SLOTS)


def test_snapshot_limits(spark):
    o = orders(
        spark,
        [
            ("never", ago(100), "completed", True),
            ("gap13", ago(100), "completed", True),
            ("gap14", ago(100), "completed", True),
            ("t29", ago(29), "completed", True),
            ("t30", ago(30), "completed", True),
            ("failed", ago(5), "cancelled", True),
            ("second", ago(5), "completed", False),
        ],
    )
    s = slots(
        spark,
        [("gap13", ago(13), "EVALUATED"), ("gap14", ago(14), "NO_SHOW"), ("t29", ago(1), "PUBLISHED"),
         ("t30", ago(1), "PUBLISHED"), ("never", ago(1), "DELETED")],
    )
    got = {r["rider_id"]: r for r in activity.activity_snapshot(o, s, P).collect()}
    assert set(got) == {"never", "gap13", "gap14", "t29", "t30"}
    assert {k: r["is_churned"] for k, r in got.items()} == {"never": 1, "gap13": 0, "gap14": 1, "t29": 0, "t30": 0}
    assert got["never"]["days_since_last_slot"] == 100
    first = ago(100)
    assert got["never"]["week_of_churn"] == first - timedelta(days=first.weekday())
    assert got["gap13"]["week_of_churn"] is None
    assert (got["t29"]["segment"], got["t30"]["segment"]) == ("newbie", "active")
    assert activity.churned_count(activity.activity_snapshot(o, s, P)).first()[0] == 2


def test_newbie_limit_is_a_parameter(spark):
    base = spark.createDataFrame([("new", 10), ("old", 90), ("none", 5), ("unknown", None)], "rider_id string, tenure_days int")
    s = slots(spark, [("new", ago(8), "EVALUATED"), ("old", ago(8), "EVALUATED"), ("unknown", ago(1), "EVALUATED")])
    got = {r["rider_id"]: tuple(r)[1:] for r in activity.label_churn(s, base, P.but(newbie_churn_days=7)).collect()}
    assert got == {"new": (1, 8, "newbie"), "old": (0, 8, "active"), "none": (1, None, "newbie"), "unknown": (0, 1, "active")}


def test_anchor_of_unknown_first_order(spark):
    o = orders(spark, [("r", ago(3), "completed", True)])
    attrs = spark.createDataFrame([("r", None, None)], "rider_id string, first_order_creation_datetime timestamp, last_order_creation_datetime timestamp")
    s = slots(spark, [("r", ago(2), "EVALUATED")])
    row = activity.rider_anchor(activity.eligible_entities(o, P), attrs, s, P).first()
    assert row["segment"] == "active" and row["week_of_churn"] is None
    assert row["anchor_week"] == date(2026, 5, 11)


def test_week_border(spark):
    s = spark.createDataFrame(
        [("PL", "r", date(2026, 5, 3), datetime(2026, 5, 3, 23, 59, 59), "EVALUATED"),
         ("PL", "r", date(2026, 5, 4), datetime(2026, 5, 4, 0, 0), "EVALUATED")],
        SLOTS,
    )
    eligible = spark.createDataFrame([("r",)], "rider_id string")
    got = activity.booking_gaps(s, eligible, P).collect()
    assert [(r["week"], r["slot_gap_mean_days"]) for r in got] == [(date(2026, 5, 4), 1.0)]


def test_gaps_match_slot_level_lag(spark):
    """A rider with most of the slots and several slots a day, against the row-level definition."""
    rng = np.random.default_rng(3)
    rows = [("hot", ago(int(d)), "EVALUATED") for d in rng.integers(0, 120, 3000)]
    rows += [(f"r{i}", ago(int(d)), "EVALUATED") for i in range(20) for d in rng.integers(0, 120, 6)]
    rows += [("one", ago(4), "EVALUATED"), ("twice", ago(4), "EVALUATED"), ("twice", ago(4), "EVALUATED")]
    eligible = spark.createDataFrame([(r,) for r in {r for r, _, _ in rows}], "rider_id string")
    s = slots(spark, rows)
    got = activity.booking_gaps(s, eligible, P).toPandas()
    pdf = pd.DataFrame(rows, columns=["rider_id", "day", "s"]).sort_values(["rider_id", "day"])
    pdf["day"] = pd.to_datetime(pdf["day"])
    pdf["gap"] = pdf.groupby("rider_id")["day"].diff().dt.days
    pdf["week"] = (pdf["day"] - pd.to_timedelta(pdf["day"].dt.weekday, unit="D")).dt.date
    want = pdf.dropna(subset=["gap"]).groupby(["rider_id", "week"])["gap"].agg(["mean", "max"]).reset_index()
    got = got.sort_values(["rider_id", "week"]).reset_index(drop=True)
    assert got[["rider_id", "week"]].values.tolist() == want[["rider_id", "week"]].values.tolist()
    assert np.allclose(got["slot_gap_mean_days"], want["mean"])
    assert got["slot_gap_max_days"].tolist() == want["max"].tolist()
    # each rider and day is one row before the window
    assert activity.booking_days(s, P).where("rider_id = 'hot'").count() <= 121
    spread = {r["rider_id"]: r["booking_regularity"] for r in activity.booking_patterns(s, P).collect()}
    std = pdf.groupby("rider_id")["gap"].std()
    assert abs(spread["hot"] - std["hot"]) < 1e-9 and spread["one"] is None


DELIVERIES = (
    "country_code string, rider_id string, order_id bigint, delivery_id string, global_order_id bigint, zone_name string, report_date date, "
    "creation_date_local date, delivery_status string, total_stacked_deliveries int, pickup_distance_google_in_meters double, "
    "dropoff_distance_google_in_meters double, auto_transition_dropoff string, at_customer_time_in_seconds double, "
    "rider_near_restaurant_at timestamp_ntz, at_vendor_time_in_seconds double, courier_delivery_time_in_seconds double, "
    "total_reassignments bigint, total_deliveries bigint"
)
PAYMENTS = (
    "country_code string, global_order_id bigint, city_code string, order_final_status string, is_dh_data boolean, order_is_standard boolean, "
    "primary_delivery_count bigint, total_compensation_local_currency double, rain_bonus_cost_local_currency double, snow_bonus_cost_local_currency double"
)


def delivery(rider, order, n, near=None, vendor=None):
    return ("PL", rider, order, f"{order}-{n}", order, "z", ago(2), ago(2), "completed", n, 1000.0, None, None, 120.0, near, vendor, 600.0, 0, 1)


def test_pay_repeats_per_delivery_unless_deduped(spark):
    d = spark.createDataFrame([delivery("r", 1, 0, noon(ago(2)), None), delivery("r", 1, 1), delivery("r", 9, 0)], DELIVERIES)
    r = spark.createDataFrame([("PL", 1, "c", "DeliveredStatus", None, True, 1, 10.0, 1.0, None)], PAYMENTS)
    row = weekly.weekly_delivery_economics(d, r, P).first()
    assert (row["total_earnings"], row["total_orders_cpo"], row["perc_stacking"]) == (20.0, 2, 0.5)
    assert row["total_bw_orders"] == 0  # an unknown snow bonus makes the weather test unknown
    assert row["net_cpo_lc"] is None and row["avg_pd_distance_google"] is None and row["avg_total_distance_google"] is None
    assert row["at_vendor_time_in_minutes"] is None
    once = weekly.weekly_delivery_economics(d, r, P, dedupe_orders=True).first()
    assert (once["total_earnings"], once["total_orders_cpo"]) == (10.0, 1)


def test_unknown_status_gives_null_orders(spark):
    d = spark.createDataFrame([delivery("r", 1, 0)], DELIVERIES)
    r = spark.createDataFrame([("PL", 1, "c", None, True, True, 1, 10.0, 0.0, 0.0)], PAYMENTS)
    row = weekly.weekly_delivery_economics(d, r, P).first()
    assert row["total_orders_cpo"] is None and row["cpo_local_currency"] is None and row["total_earnings"] == 10.0


COMPLIANCE = (
    "country_code string, rider_id string, created_at timestamp_ntz, created_date date, violations array<struct<id:string,"
    "actions:array<struct<type:string>>,rules:array<struct<violation_type:string>>>>"
)


def test_violations_need_actions_and_rules(spark):
    rows = [
        ("PL", "r", noon(ago(2)), ago(2), [("v1", [("a",), ("b",)], [("x",), ("y",), ("z",)])]),
        ("PL", "r", noon(ago(2)), ago(2), [("v2", [], [("x",)])]),
        ("PL", "r", noon(ago(2)), ago(2), [("v3", [("a",)], [])]),
        ("PL", "r", noon(ago(2)), ago(2), []),
    ]
    c = spark.createDataFrame(rows, COMPLIANCE)
    row = weekly.weekly_violations(c, P).first()
    assert (row["compliance_total_violations"], row["compliance_distinct_violation_types"]) == (1, 3)
    assert weekly.violations_by_type_action(c, P).count() == 6


def test_newest_source_may_be_missing(spark):
    rows = [("PL", "r", noon(ago(9)), (("ads",),)), ("PL", "r", noon(ago(1)), ((None,),))]
    a = spark.createDataFrame(rows, "country_code string, rider_id string, created_at timestamp_ntz, custom_non_pii_fields struct<utm:struct<source:string>>")
    row = weekly.acquisition_source(a).first()
    assert row["utm_source"] is None and row["registration_date"] == ago(9)


def test_holiday_calendar(spark):
    weeks = {r["week"]: r["holiday_days_in_week"] for r in weekly.holiday_weeks(weekly.holiday_calendar(spark), P).collect()}
    assert sum(weeks.values()) == 17 and weeks[date(2025, 12, 22)] == 2


def test_reason_labels(spark):
    rows = [(noon(ago(2)), ("r", code, "PL", "Create")) for code in ("15A.1", "99Z", None)] + [(noon(ago(2)), ("r", "15A.1", "PL", "Close"))]
    t = spark.createDataFrame(rows, "timestamp timestamp_ntz, content struct<rider_id:string,contact_reason_code:string,global_entity_id:string,action:string>")
    got = {r["contact_reason_code"]: r["ticket_count"] for r in weekly.ticket_reasons(t, P).collect()}
    assert got == {"address_change": 1, "99Z": 1, "unknown": 1}


def test_trends_on_sparse_families(spark):
    cols = ", ".join(f"m_W{k} double" for k in range(8))
    rows = [
        ("none", *[None] * 8),
        ("two", 1.0, 2.0, *[None] * 6),
        ("three", 1.0, None, 3.0, None, None, None, None, 8.0),
        ("zero", 5.0, 0.0, 0.0, *[None] * 5),
        ("nan", float("nan"), 1.0, float("inf"), 2.0, 4.0, None, None, None),
    ]
    got = {r["id"]: r for r in features.wow_trends(spark.createDataFrame(rows, f"id string, {cols}")).collect()}
    assert got["two"]["m_trend_slope_8w"] is None and got["two"]["m_wow_delta_W0_W1"] == -1.0
    want = np.polyfit([0, 5, 7], [8.0, 3.0, 1.0], 1)[0]
    assert abs(got["three"]["m_trend_slope_8w"] - want) < 1e-12
    assert got["zero"]["m_wow_pct_change_W0_W1"] is None and got["zero"]["m_wow_delta_W0_W1"] == 5.0
    assert abs(got["nan"]["m_trend_slope_8w"] - np.polyfit([3, 4, 6], [4.0, 2.0, 1.0], 1)[0]) < 1e-12
    assert got["nan"]["m_wow_delta_W0_W1"] is None and got["none"]["m_trend_slope_8w"] is None


def test_per_order_with_zero_orders(spark):
    df = spark.createDataFrame([(0, 5.0), (2, 5.0), (None, 5.0)], "total_orders_cpo_W0 int, total_earnings_W0 double")
    assert sorted(str(r["total_earnings_per_order_W0"]) for r in features.per_order_features(df).collect()) == ["2.5", "None", "None"]


def test_weekly_families_skip_derived_names():
    from stayrate.functions.common import weekly_families

    names = ["a_W0", "a_W1", "season_W0", "a_delta_W0_W1", "a_wow_delta_W0_W1", "b_W3", "b_W7", "c_trend_slope_8w"]
    assert weekly_families(names) == ["a", "b"]
