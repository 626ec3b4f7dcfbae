"""Every operator as a query over the star schema tables.

A query takes the session and the folder of the tables, reads whole tables and returns a flat frame:
dates as ISO text, whole numbers as bigint, doubles rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.functions import common
from stayrate.functions.ordering import durable
from stayrate.functions.rules import WEEKLY_METRICS
from stayrate.operators import activity, correlate, drift, evaluate, features, lifetime, ml, panel, score, weekly
from stayrate.params import Params
from stayrate.plans import build
from stayrate.sources import roles, sinks, tables
from stayrate.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

WEEK = Params(as_of=date(2001, 8, 1), start=date(1995, 1, 1), history_start=None, churn_days=180)
# One of the countries among which the riders are dealt, with its code in each source.
ONE = {
    "country": "m1",
    "country_codes": tuple((s, c.format(1)) for s, c in (("contacts", roles.CONTACT_CODE), ("tickets", roles.TICKET_CODE), ("applicants", roles.APPLICANT_CODE))),
    "label": "one",
}
QUARTER = WEEK.but(period="quarter", newbie_days=2250, early_lookback_days=None)

_REGISTRY: dict[str, Query] = {}


def query(fn: Callable[[roles.Star], DataFrame]) -> Callable[[roles.Star], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(fn(roles.Star(spark, sf_dir)))

    run.__doc__ = fn.__doc__
    _REGISTRY[fn.__name__] = run
    return fn


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain column types that any engine prints alike."""

    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("date").cast("string")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # the small shift puts exact halves on the same side in every engine
            c = F.round(c.cast("double") + F.lit(3.7e-9), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def _eligible(star: roles.Star) -> DataFrame:
    return activity.eligible_entities(roles.orders_nested(star), WEEK)


def _anchor(star: roles.Star, p: Params) -> DataFrame:
    return activity.rider_anchor(
        activity.eligible_entities(roles.orders_nested(star), p), roles.attributes(star), roles.slots(star), p
    )


def _among(star: roles.Star, rows: DataFrame) -> DataFrame:
    return activity.only_eligible(rows, _eligible(star))


# ---- activity ------------------------------------------------------------------------------------


@query
def activity_snapshot(star):
    return activity.activity_snapshot(roles.orders_nested(star), roles.slots(star), WEEK)


def _dealt(star: roles.Star) -> roles.Star:
    """The same tables with riders of several countries."""
    return roles.Star(star.spark, star.folder, split=True)


@query
def snapshot_country(star):
    star = _dealt(star)
    return activity.activity_snapshot(roles.orders_nested(star), roles.slots(star), WEEK.but(**ONE))


@query
def churned_count(star):
    snapshot = activity.activity_snapshot(roles.orders_nested(star), roles.slots(star), WEEK)
    return activity.churned_count(snapshot)


@query
def eligible_riders(star):
    return _eligible(star)


@query
def churned_riders(star):
    return activity.churned_riders(_anchor(star, WEEK))


@query
def relative_periods(star):
    rows = activity.relative_periods(_anchor(star, QUARTER), QUARTER)
    return rows.select("rider_id", "segment", "week_of_churn", "week_offset", "feature_week")


@query
def booking_gaps(star):
    return activity.booking_gaps(roles.slots(star), _eligible(star), WEEK)


@query
def label_by_segment_threshold(star):
    p = WEEK.but(newbie_days=2250, newbie_churn_days=90)
    base = roles.attributes(star).select(
        "rider_id", F.datediff(F.lit(p.as_of), F.to_date("first_order_creation_datetime")).alias("tenure_days")
    )
    return activity.label_churn(roles.slots(star), base, p)


@query
def booking_patterns(star):
    return activity.booking_patterns(roles.slots(star), WEEK)


# ---- sources -------------------------------------------------------------------------------------


@query
def filtered_scan(star):
    return tables.filtered_scan(
        star.table("orders"),
        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"],
        "o_orderdate",
        date(1996, 1, 1),
        date(2001, 8, 1),
        required=["o_custkey", "o_orderdate"],
    )


@query
def flattened_deliveries(star):
    rows = activity.flatten_deliveries(roles.orders_nested(star))
    return rows.groupBy("delivery_status", "is_primary").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("rider_id").alias("riders")
    )


@query
def outer_flatten(star):
    rows = roles.compliance(star).select("rider_id", F.explode_outer("violations").alias("v"))
    return rows.groupBy("rider_id").agg(F.count(F.lit(1)).alias("records"), F.count("v.id").alias("violations"))


@query
def city_extract(star):
    slots = roles.slots(star).join(
        star.homes().select(F.col("c_custkey").cast("string").alias("rider_id"), F.col("n_name").alias("city_code")),
        "rider_id",
    )
    recent = tables.city_extract(slots, "NATION_3", WEEK.as_of, "created_date", 365)
    return recent.select("rider_id", "city_code", "created_date", "shift_state")


@query
def courier_base_extract(star):
    base = roles.rider_base(star).withColumnRenamed("city", "city_code")
    return tables.courier_base_extract(base, "NATION_3", WEEK.as_of, 2400)


@query
def parameter_query(star):
    sql = """
        SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total
        FROM {orders}
        WHERE o_orderdate >= CAST(:since AS DATE) AND o_orderstatus <> :status
        GROUP BY o_orderpriority
    """
    return tables.parameter_query(
        star.spark, sql, {"since": "1997-01-01", "status": "P"}, orders=star.table("orders")
    )


@query
def first_rows(star):
    return tables.first_rows(
        star.table("orders").select("o_orderkey", "o_totalprice"), 1000, ["o_totalprice", "o_orderkey"]
    )


@query
def coerced_values(star):
    """Numbers and dates from text; what does not parse becomes NULL."""
    text = F.col("c_name")
    rows = star.table("customer").select(
        "c_custkey",
        common.to_number(F.when(F.col("c_custkey") % 2 == 0, F.substring(text, 10, 20)).otherwise(text)).alias("number"),
        common.to_day(F.when(F.col("c_custkey") % 3 == 0, F.lit("1999-02-03")).otherwise(text)).alias("day"),
        F.coalesce(common.to_number(text), F.lit(7.0)).alias("filled"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("clipped"),
    )
    return rows


@query
def playbook_rows(star):
    return tables.normalise_playbook(roles.playbook_sheet(star))


# ---- weekly aggregates ---------------------------------------------------------------------------


@query
def weekly_shift_kpis(star):
    return _among(star, weekly.weekly_shift_kpis(roles.daily_kpi(star), WEEK))


@query
def weekly_delivery_economics(star):
    return _among(star, weekly.weekly_delivery_economics(roles.deliveries(star), roles.payments(star), WEEK))


@query
def weekly_delivery_deduped(star):
    return weekly.weekly_delivery_economics(roles.deliveries(star), roles.payments(star), QUARTER, True).select(
        "rider_id", "week", "total_orders_cpo", "total_earnings", "total_bw_orders"
    )


@query
def weekly_kpi_variant(star):
    return weekly.weekly_kpi_variant(
        roles.deliveries(star), roles.payments(star), roles.daily_kpi(star), WEEK.but(seconds_per_hour=60.0)
    )


@query
def weekly_tickets(star):
    return _among(star, weekly.weekly_tickets(roles.contacts(star), WEEK))


@query
def ticket_reasons(star):
    return weekly.ticket_reasons(roles.ticket_stream(star), WEEK)


@query
def weekly_tickets_country(star):
    return weekly.weekly_tickets(roles.contacts(_dealt(star)), WEEK.but(**ONE))


@query
def ticket_reasons_country(star):
    return weekly.ticket_reasons(roles.ticket_stream(_dealt(star)), WEEK.but(**ONE))


@query
def weekly_violations(star):
    return _among(star, weekly.weekly_violations(roles.compliance(star), WEEK))


@query
def violations_by_type_action(star):
    return weekly.violations_by_type_action(roles.compliance(star), WEEK)


def _weekly_pair(star: roles.Star, p: Params) -> tuple[DataFrame, DataFrame]:
    eligible = _eligible(star)
    d = weekly.weekly_delivery_economics(roles.deliveries(star), roles.payments(star), p)
    k = weekly.weekly_shift_kpis(roles.daily_kpi(star), p)
    return activity.only_eligible(d, eligible), activity.only_eligible(k, eligible)


@query
def city_benchmark(star):
    return weekly.city_benchmark(*_weekly_pair(star, QUARTER))


@query
def acquisition_source(star):
    return weekly.acquisition_source(roles.applicants(star))


@query
def acquisition_source_country(star):
    return weekly.acquisition_source(roles.applicants(_dealt(star)), WEEK.but(**ONE).country_of("applicants"))


@query
def holiday_weeks(star):
    return weekly.holiday_weeks(roles.order_day_calendar(star), WEEK)


# ---- feature tables ------------------------------------------------------------------------------


def _wide(star: roles.Star) -> DataFrame:
    return build.feature_table(roles.sources(star), QUARTER, calendar=roles.order_day_calendar(star))


@query
def early_life(star):
    src = roles.sources(star)
    d, k = _weekly_pair(star, QUARTER)
    return features.early_life(
        _anchor(star, QUARTER),
        src.orders_nested,
        src.compliance,
        weekly.acquisition_source(src.applicants),
        d,
        weekly.city_benchmark(d, k),
        QUARTER,
    )


@query
def combine_weekly(star):
    ready = build.prepare(roles.sources(star), QUARTER, calendar=roles.order_day_calendar(star))
    return ready.combined


@query
def pivot_features(star):
    return _wide(star)


@query
def pivot_features_country(star):
    star = _dealt(star)
    return build.feature_table(roles.sources(star), QUARTER.but(**ONE), calendar=roles.order_day_calendar(star))


def _some(wide: DataFrame, *metrics: str) -> DataFrame:
    return wide.select("rider_id", *[f"{m}_W{k}" for m in metrics for k in range(8)])


def _order_history(star: roles.Star) -> DataFrame:
    """Quarterly order counts and pay per rider in wide form, from the orders table alone."""
    p = QUARTER
    anchor = F.date_trunc("quarter", F.lit(p.as_of)).cast("date")
    steps = common.periods_between(anchor, common.period_start("o_orderdate", "quarter"), "quarter")
    rows = star.table("orders").select(F.col("o_custkey").cast("string").alias("rider_id"), steps.alias("k"), "o_totalprice", "o_orderstatus")
    inside = [F.col("k") == k for k in range(8)]
    late = F.sum((F.col("o_orderstatus") == "P").cast("bigint"))
    return rows.groupBy("rider_id").agg(
        *[F.sum(F.when(inside[k], F.lit(1)).cast("bigint")).alias(f"total_orders_cpo_W{k}") for k in range(8)],
        *[F.sum(F.when(inside[k], F.col("o_totalprice"))).alias(f"total_earnings_W{k}") for k in range(8)],
        *[F.sum(F.when(inside[k], (F.col("o_orderstatus") == "P").cast("bigint"))).alias(f"no_shows_W{k}") for k in range(8)],
        late.alias("late_total"),
    )


@query
def per_order(star):
    return features.per_order_features(_order_history(star))


@query
def wow_trends(star):
    return features.wow_trends(_order_history(star))


@query
def period_deltas(star):
    wide = _wide(star)
    return wide.select("rider_id", *[c for c in wide.columns if "_delta_" in c])


@query
def rfm(star):
    wide = _wide(star)
    return wide.select("rider_id", *wide.columns[-15:-7])


@query
def labelled_cross_section(star):
    snapshot = activity.activity_snapshot(roles.orders_nested(star), roles.slots(star), QUARTER)
    return features.labelled_cross_section(_order_history(star), snapshot)


@query
def per_order_all(star):
    """Per-order measures over all families of the feature table."""
    return features.per_order_features(_wide_all(star))


@query
def wow_trends_all(star):
    """Trends of all families of the feature table."""
    return features.wow_trends(_wide_all(star))


@query
def labelled_cross_section_all(star):
    snapshot = activity.activity_snapshot(roles.orders_nested(star), roles.slots(star), QUARTER)
    return features.labelled_cross_section(_wide_all(star), snapshot)


#: Families of the panel query that is compared with SQL; forward_panel_all and the models take all.
PANEL_FAMILIES = ("total_orders_cpo", "total_earnings", "no_shows", "hours_worked", "slot_gap_mean_days")


def _wide_all(star: roles.Star) -> DataFrame:
    return build.history_table(roles.sources(star), QUARTER, calendar=roles.order_day_calendar(star))


def _panel(star: roles.Star, families: Sequence[str] = WEEKLY_METRICS, **options) -> DataFrame:
    """The panel over a table of one row per rider."""
    src = roles.sources(star)
    riders = build.rider_activity(src, QUARTER)
    wide = build.history_table(src, QUARTER, families, roles.order_day_calendar(star), riders)
    snapshot = activity.activity_snapshot(src.orders_nested, src.slots, QUARTER, riders)
    return panel.forward_event_panel(wide, snapshot, QUARTER, unique_riders=True, **options)


@query
def forward_panel(star):
    return _panel(star, PANEL_FAMILIES, derive=False)


@query
def forward_panel_all(star):
    """The panel with all families and the derived columns."""
    return _panel(star)


@query
def forward_panel_full_history(star):
    src = roles.sources(star)
    p = QUARTER.but(max_offset=3)
    riders = build.rider_activity(src, p)
    wide = build.history_table(src, p.but(n_periods=11), ("total_orders_cpo", "total_earnings"), riders=riders)
    snapshot = activity.activity_snapshot(src.orders_nested, src.slots, p, riders)
    return panel.forward_event_panel(
        wide, snapshot, p, derive=False, unique_riders=True, tenure_at_event=True, label_delay_periods=1
    )


@query
def forward_panel_full_history_all(star):
    """The panel with all families, derived columns and offsets, its lags filled from the longer history."""
    return build.training_panel(
        roles.sources(star), QUARTER, full_history=True, calendar=roles.order_day_calendar(star), tenure_at_event=True, label_delay_periods=1
    )


@query
def time_split(star):
    rows = durable(_panel(star).select("rider_id", "event_week", "is_churned"))
    train, test, how = panel.time_split(rows)
    both = train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(
        F.lit(how).alias("how"),
        F.count(F.lit(1)).alias("rows"),
        F.min("event_week").alias("first_week"),
        F.max("event_week").alias("last_week"),
        F.avg("is_churned").alias("positive_rate"),
    )


@query
def last_period_split(star):
    rows = roles.scores(star)
    train, test = panel.last_period_split(rows)
    both = train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.avg("y").alias("positive_rate"))


@query
def stratified_split(star):
    """Share of each class in the test part; the draw itself is a seeded hash."""
    rows = roles.scores(star).select("id", F.col("y").alias("is_churned"), "p")
    train, test = panel.stratified_split(rows, key="id")
    both = train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "is_churned").agg(F.count(F.lit(1)).alias("rows"))


# ---- evaluation ----------------------------------------------------------------------------------


@query
def roc_auc(star):
    return evaluate.roc_auc(roles.scores(star))


@query
def avg_precision(star):
    return evaluate.average_precision(roles.scores(star))


@query
def brier(star):
    return evaluate.brier(roles.scores(star))


@query
def ece(star):
    return evaluate.expected_calibration_error(roles.scores(star))


@query
def precision_at_k(star):
    return evaluate.precision_at_k(roles.scores(star), 500)


@query
def ranking_at_k(star):
    return evaluate.ranking_at_k(roles.scores(star))


@query
def threshold_capacity(star):
    return evaluate.threshold_capacity(roles.scores(star))


@query
def calibration(star):
    return evaluate.calibration_table(roles.scores(star))


@query
def weekly_backtest(star):
    return evaluate.weekly_backtest(roles.scores(star))


@query
def threshold_report(star):
    return evaluate.threshold_report(roles.scores(star), 0.25)


@query
def segment_report(star):
    return evaluate.segment_report(roles.scores(star), threshold=0.25)


@query
def label_rate(star):
    return drift.label_rate(roles.scores(star), label="y", by=["segment"])


@query
def label_rate_by_week(star):
    return drift.label_rate(roles.scores(star), label="y")


def _order_measures(star: roles.Star) -> DataFrame:
    return star.table("orders").join(star.homes(), F.col("o_custkey") == F.col("c_custkey")).select(
        common.period_start("o_orderdate", "quarter").alias("event_week"),
        F.col("r_name").alias("country_code"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "newbie").otherwise("active").alias("segment"),
        F.col("o_totalprice").alias("total"),
        (F.col("o_orderkey") % 7).cast("double").alias("spread"),
        F.when(F.month("o_orderdate") > 3, F.col("c_acctbal")).alias("partly_known"),
    )


@query
def feature_drift(star):
    return drift.feature_drift(_order_measures(star), features=["total", "spread", "partly_known"])


@query
def feature_drift_by_segment(star):
    return drift.feature_drift(
        _order_measures(star), by=["country_code", "segment"], features=["total", "spread", "partly_known"]
    )


# ---- scoring, drivers, actions -------------------------------------------------------------------


def _explained(star: roles.Star) -> DataFrame:
    return build.with_drivers(score.rank_rows(roles.scored_riders(star)))


@query
def risk_rank_dense(star):
    ranked = score.score_and_rank(roles.scored_riders(star), 0.5)
    return ranked.select("rider_id", "city_code", "segment", "churn_probability", "is_high_risk", "risk_rank")


@query
def risk_rank_rows(star):
    return score.rank_rows(roles.scored_riders(star)).select("rider_id", "churn_probability", "risk_rank")


@query
def risk_top_fraction(star):
    top = score.top_fraction(roles.scored_riders(star), "country_code", 0.10)
    return top.select("rider_id", "country_code", "group_rank", "group_rows", "top_rows")


@query
def city_summary(star):
    ranked = roles.scored_riders(star).withColumn("is_high_risk", F.col("churn_probability") >= 0.5)
    return score.city_summary(ranked, "city_code")


@query
def contributions_z(star):
    rows, _ = score.contributions(roles.scored_riders(star), ("rider_id",))
    return rows


@query
def category_scores(star):
    rows, names = score.contributions(roles.scored_riders(star), ("rider_id",))
    cats = score.category_scores(names)
    return rows.select("rider_id", *cats)


@query
def top_drivers(star):
    rows = _explained(star).select("rider_id", F.posexplode("top_feature_contributions").alias("pos", "d"))
    return rows.select("rider_id", "pos", "d.feature", "d.impact_score")


@query
def city_signals(star):
    return score.city_signals(_explained(star), ["country_code", "city_code"])


@query
def driver_actions(star):
    rows = score.driver_actions(_explained(star))
    return rows.select("rider_id", F.posexplode("recommended_actions").alias("pos", "a")).select(
        "rider_id", "pos", "a.driver", "a.action", "a.owner", "a.effort"
    )


@query
def country_context(star):
    cities = score.country_cities(durable(_explained(star)), newbie_cost=10.0)
    return cities.select(
        "country_code",
        "city_code",
        "city_rank",
        "total_riders_week",
        "top_decile_riders",
        "riders_in_top_decile",
        "share_of_country_top_decile",
        "avg_churn_probability",
        F.array_join("dominant_categories.category", "|").alias("categories"),
        F.array_join("city_top_feature_signals.feature", "|").alias("signals"),
        "newbie_high_risk_count",
        "newbie_gac_exposure",
        F.size("sample_riders").alias("samples"),
    )


def _plan(star: roles.Star) -> DataFrame:
    book = tables.normalise_playbook(roles.playbook_sheet(star))
    return build.city_plan(durable(_explained(star)), book)


@query
def playbook_match(star):
    rows = _plan(star).select("country_code", "city_code", F.posexplode("playbook_candidates").alias("pos", "c"))
    return rows.select("country_code", "city_code", "pos", "c.action", "c.owner", "c.estimated_cost", "c.match_score")


@query
def action_payload(star):
    context = score.country_context(_plan(star))
    body = score.action_payload(context, "2001-07-30", "boosted_trees", {"roc_auc": 0.5}, "2001-08-01T00:00:00Z", [100, 250])
    doc = "struct<event_type:string,country_code:string,model:struct<name:string,ranking_snapshot:struct<top_3_cities:array<struct<city_code:string,riders_in_top_decile:bigint>>>>>"
    parsed = body.select(F.from_json("payload", doc).alias("j"))
    cities = parsed.select("j.event_type", "j.country_code", "j.model.name", F.explode("j.model.ranking_snapshot.top_3_cities").alias("c"))
    return cities.select("event_type", "country_code", "name", "c.city_code", "c.riders_in_top_decile")


@query
def importance_cumshare(star):
    rows = star.table("part").select(F.col("p_partkey").cast("string").alias("feature"), F.col("p_retailprice").alias("importance"))
    return evaluate.importance_table(rows)


# ---- correlation ---------------------------------------------------------------------------------


def _kpi_weeks(star: roles.Star) -> DataFrame:
    return weekly.weekly_kpi_variant(roles.deliveries(star), roles.payments(star), roles.daily_kpi(star), WEEK)


@query
def kpi_rider_means(star):
    return correlate.rider_means(_kpi_weeks(star))


def _long(df: DataFrame, name: str) -> DataFrame:
    values = [c for c in df.columns if c != "rider_id"]
    return df.unpivot(["rider_id"], [F.col(f"`{c}`") for c in values], name, "value")


@query
def contact_topn_pivot(star):
    return _long(correlate.contact_topn_pivot(weekly.ticket_reasons(roles.ticket_stream(star), WEEK)), "reason")


@query
def violation_pivot(star):
    return _long(correlate.violation_pivot(weekly.violations_by_type_action(roles.compliance(star), WEEK)), "name")


@query
def ever_flag(star):
    src = star.table("events").select(
        F.col("user_id").alias("rider_id"),
        (F.col("event_type") == "error").cast("int").alias("is_churned"),
        F.col("value").alias("tenure_days"),
    )
    return correlate.ever_flag(src)


def _merged(star: roles.Star) -> DataFrame:
    kpi = correlate.rider_means(_kpi_weeks(star))
    contacts = correlate.contact_topn_pivot(weekly.ticket_reasons(roles.ticket_stream(star), WEEK))
    compliance = correlate.violation_pivot(weekly.violations_by_type_action(roles.compliance(star), WEEK))
    churn = correlate.churn_snapshot_columns(
        activity.activity_snapshot(roles.orders_nested(star), roles.slots(star), WEEK)
    )
    return correlate.merge_riders(
        kpi, correlate.exposure_normalise(contacts, kpi), correlate.exposure_normalise(compliance, kpi), churn
    )


@query
def target_correlation(star):
    return correlate.target_correlation(_merged(star))


@query
def correlation_matrix(star):
    return correlate.correlation_matrix(
        correlate.rider_means(_kpi_weeks(star)), ["no_shows", "hours_worked", "total_earnings", "cdt", "perc_reas"]
    )


@query
def exposure_normalise(star):
    kpi = correlate.rider_means(_kpi_weeks(star))
    tickets = weekly.weekly_tickets(roles.contacts(star), WEEK).groupBy("rider_id").agg(
        F.sum("contacts_total_tickets").alias("total_tickets")
    )
    return correlate.exposure_normalise(tickets, kpi)


# ---- lifetime features ---------------------------------------------------------------------------


@query
def earnings_windows(star):
    return lifetime.earnings_features(roles.rider_orders(star), roles.rider_slots(star), WEEK)


@query
def earnings_trends(star):
    return lifetime.earnings_trends(roles.rider_orders(star), WEEK)


@query
def experience(star):
    return lifetime.experience_features(
        roles.rider_orders(star), roles.rider_contacts(star), roles.rider_slots(star), WEEK, recent=15
    )


@query
def contact_trend(star):
    return lifetime.contact_features(roles.rider_contacts(star), WEEK, recent=15)


@query
def engagement(star):
    return lifetime.engagement_features(
        roles.rider_orders(star), roles.rider_slots(star), roles.rider_violations(star), roles.rider_base(star), WEEK, recent=90
    )


@query
def balance_risk(star):
    return lifetime.balance_features(
        roles.rider_orders(star), roles.rider_balances(star), roles.rider_base(star), WEEK
    )


@query
def feature_matrix(star):
    return lifetime.feature_matrix(
        roles.rider_orders(star),
        roles.rider_slots(star),
        roles.rider_contacts(star),
        roles.rider_violations(star),
        roles.rider_base(star),
        roles.rider_balances(star),
        WEEK,
    )


# ---- models --------------------------------------------------------------------------------------


def _model_panel(star: roles.Star) -> DataFrame:
    """The panel with all families and the derived columns."""
    return durable(_panel(star))


@query
def ml_train_score(star):
    """All candidates on the time split, the champion saved, loaded and applied to the newest period."""
    rows = _model_panel(star)
    train, test, _ = panel.time_split(rows)
    fitted = ml.fit_candidates(train, test, ml.candidate_models())
    best = ml.best_candidate(fitted)
    folder = sinks.work_folder(star.spark, "model")
    ml.save_model(best.model, folder)
    ranked = build.rank_week(rows, ml.load_model(folder), keep=["rider_id", "event_week"])
    return ranked.select("rider_id", "churn_probability", "risk_rank", "event_week")


@query
def ml_importance(star):
    rows = _model_panel(star)
    train, test, _ = panel.time_split(rows)
    forest = {"random_forest": ml.candidate_models()["random_forest"]}
    fitted = ml.fit_candidates(train, test, forest)["random_forest"]
    return ml.feature_importance(fitted.model, rows)


@query
def rolling_backtest(star):
    """All periods of the panel as folds."""
    rows = _model_panel(star)
    return ml.rolling_backtest(rows, lambda: ml.candidate_models()["logistic_regression"], "logistic_regression")


@query
def backtest_folds(star):
    """Periods, sizes and rates of the folds of the rolling backtest."""
    return ml.backtest_folds(_panel(star, derive=False))


@query
def fold_fillings(star):
    """What every fold fills and scales the weekly columns with, from facts per period."""
    rows = durable(_panel(star, derive=False))
    return ml.fold_fillings(rows, [f"{m}_W{k}" for m in WEEKLY_METRICS for k in range(8)])


@query
def csv_roundtrip(star):
    snapshot = activity.activity_snapshot(roles.orders_nested(star), roles.slots(star), WEEK)
    path = sinks.write_csv(flat(snapshot), sinks.work_folder(star.spark, "snapshot"))
    schema = (
        "rider_id string, segment string, start_week_of_tenure date, tenure_days bigint, week_of_churn date, "
        "days_since_last_slot bigint, is_churned int, churn int"
    )
    return tables.read_csv(star.spark, path, schema)


@query
def report_sinks(star):
    rows = roles.scores(star)
    reports = {
        "ranking": evaluate.ranking_at_k(rows),
        "threshold": evaluate.threshold_capacity(rows),
        "calibration": evaluate.calibration_table(rows),
        "weekly": evaluate.weekly_backtest(rows),
        "label_rate": drift.label_rate(rows, label="y"),
    }
    folder = sinks.work_folder(star.spark, "reports")
    paths = sinks.write_reports(reports, folder)
    metrics = evaluate.score_metrics(rows).first().asDict()
    summary = sinks.run_summary(
        star.spark,
        "score",
        "avg_precision",
        {"score": {k: metrics[k] for k in ("roc_auc", "avg_precision")}},
        0,
        metrics["rows"],
        0.0,
        metrics["positive_rate"],
        [100, 250, 500, 1000],
        {k: k for k in paths},
    )
    sinks.write_json(summary, f"{folder}/summary")
    counts = [star.spark.read.option("header", True).csv(p).agg(F.lit(n).alias("report"), F.count(F.lit(1)).alias("rows")) for n, p in paths.items()]
    out = star.spark.read.json(f"{folder}/summary").select(F.lit("summary").alias("report"), F.lit(1).cast("bigint").alias("rows"))
    for c in counts:
        out = out.union(c)
    return out


# ---- streaming -----------------------------------------------------------------------------------


def _event_stream(star: roles.Star) -> DataFrame:
    raw = star.table("events")
    return star.spark.readStream.schema(raw.schema).parquet(f"{star.folder}/events.parque*")


@query
def stream_ticket_counts(star):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = _event_stream(star).select(
        "event_type", F.col("user_id").cast("string").alias("rider_id"), F.col("ts").alias("timestamp"), k.alias("k")
    ).select("timestamp", roles.ticket_content().alias("content"))
    folder = sinks.work_folder(star.spark, "stream")
    incremental.run_available(incremental.ticket_counts(rows), f"{folder}/state", f"{folder}/progress")
    return incremental.current_state(star.spark, f"{folder}/state", ["week", "rider_id", "contact_reason_code"], "ticket_count")


@query
def stream_last_activity(star):
    rows = _event_stream(star).select(
        F.col("user_id").alias("rider_id"),
        F.col("ts").alias("shift_start_at"),
        F.when(F.col("event_type") == "error", "OTHER").otherwise("EVALUATED").alias("shift_state"),
    )
    folder = sinks.work_folder(star.spark, "stream")
    incremental.run_available(incremental.last_activity(rows, WEEK.slot_states), f"{folder}/state", f"{folder}/progress")
    return incremental.current_state(star.spark, f"{folder}/state", ["rider_id"], "last_slot_date")
