"""End-to-end compositions: snapshot, feature table, panel, weekly scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.ordering import durable
from stayrate.functions.rules import WEEKLY_METRICS
from stayrate.operators import activity, features, ml, panel, score, weekly
from stayrate.params import Params
from stayrate.sources.roles import Sources


@dataclass(frozen=True)
class Prepared:
    """Relations that several outputs share."""

    anchor: DataFrame
    inputs: features.WeeklyInputs
    applications: DataFrame
    combined: DataFrame


def rider_activity(src: Sources, p: Params) -> DataFrame:
    """First delivery day and eligibility per rider, written once for the weekly relations and the snapshot."""
    return durable(activity.delivery_activity(src.orders_nested, p))


def prepare(
    src: Sources, p: Params, keep: bool = True, calendar: DataFrame | None = None, riders: DataFrame | None = None
) -> Prepared:
    """Weekly relations and the long table.

    Eligible riders and the two weekly aggregates that are read several times are written once; they
    are small next to the raw tables. ``riders`` is their activity, where it is already there.
    """
    hold = durable if keep else (lambda df: df)
    if riders is None:
        eligible = hold(activity.eligible_entities(src.orders_nested, p))
    else:
        eligible = riders.where("eligible").select("rider_id")
    anchor = activity.rider_anchor(eligible, src.attributes, src.slots, p)
    delivered = hold(activity.only_eligible(weekly.weekly_delivery_economics(src.deliveries, src.payments, p), eligible))
    shifts = hold(activity.only_eligible(weekly.weekly_shift_kpis(src.kpi, p), eligible))
    inputs = features.WeeklyInputs(
        deliveries=delivered,
        shifts=shifts,
        tickets=weekly.weekly_tickets(src.contacts, p),
        violations=weekly.weekly_violations(src.compliance, p),
        gaps=activity.booking_gaps(src.slots, eligible, p),
        benchmark=weekly.city_benchmark(delivered, shifts),
        holidays=weekly.holiday_weeks(calendar if calendar is not None else weekly.holiday_calendar(eligible.sparkSession), p),
    )
    combined = features.combine_weekly(
        activity.relative_periods(
            anchor.select("rider_id", "segment", "week_of_churn", "anchor_week"), p
        ).drop("anchor_week"),
        inputs,
    )
    return Prepared(anchor, inputs, weekly.acquisition_source(src.applicants, p.country_of("applicants")), combined)


def feature_table(src: Sources, p: Params, keep: bool = True, calendar: DataFrame | None = None) -> DataFrame:
    """The wide table, one row per eligible rider."""
    ready = prepare(src, p, keep, calendar)
    early = features.early_life(
        ready.anchor,
        src.orders_nested,
        src.compliance,
        ready.applications,
        ready.inputs.deliveries,
        ready.inputs.benchmark,
        p,
    )
    dates = activity.entity_dates(src.attributes)
    history = features.rider_history(ready.combined, p.country_label)
    return features.pivot_features(history, dates, ready.applications, early)


def history_table(
    src: Sources,
    p: Params,
    metrics: Sequence[str] = WEEKLY_METRICS,
    calendar: DataFrame | None = None,
    riders: DataFrame | None = None,
) -> DataFrame:
    """Weekly measures at offsets 0..n_periods-1, written once: the input of a panel.

    It has the weekly and stable columns of the feature table, at any depth.
    """
    ready = prepare(src, p, calendar=calendar, riders=riders)
    history = features.rider_history(ready.combined, p.country_label, metrics)
    return durable(
        history.select(
            "rider_id",
            "country_code",
            *[features.stable_value(c).alias(c) for c in ("city_code", "zone_name", "vehicle_name")],
            "segment",
            "week_of_churn",
            features.at("feature_week", 0).alias("anchor_week"),
            *features.wide_weeks(metrics, p.n_periods),
        )
    )


def training_panel(
    src: Sources, p: Params, full_history: bool = False, calendar: DataFrame | None = None, **options
) -> DataFrame:
    """Forward panel straight from the source tables.

    ``full_history`` builds as many periods as the oldest event needs, so that no lag is missing only
    because of the stored depth.
    """
    riders = rider_activity(src, p)
    snapshot = activity.activity_snapshot(src.orders_nested, src.slots, p, riders)
    depth = p.but(n_periods=p.n_periods + p.max_offset) if full_history else p
    wide = history_table(src, depth, calendar=calendar, riders=riders)
    return panel.forward_event_panel(wide, snapshot, p, unique_riders=True, **options)


def rank_week(panel_rows: DataFrame, model: PipelineModel, week: str = "event_week", keep: Sequence[str] | None = None) -> DataFrame:
    """Score the newest event period and rank it; ``keep`` names the columns to go on with, all if left out."""
    newest = panel_rows.agg(F.max(week).alias("m")).first()["m"]
    scored = ml.score(model, panel_rows.where(F.col(week) == F.lit(newest)))
    return score.rank_rows(scored.select(*keep, score.PROB) if keep else scored)


def score_week(panel_rows: DataFrame, model: PipelineModel, week: str = "event_week") -> DataFrame:
    """Score the newest event period, rank it and explain it."""
    return with_drivers(rank_week(panel_rows, model, week))


def with_drivers(ranked: DataFrame) -> DataFrame:
    """Ranked riders with their drivers and family scores."""
    meta = ["rider_id", "segment", "tenure_days", "country_code", "city_code", score.PROB, "risk_rank", "event_week"]
    keep = [c for c in meta if c in ranked.columns]
    return score.explain(ranked, keep)


def city_plan(weekly_scores: DataFrame, playbook: DataFrame, share: float = 0.10, newbie_cost: float = 0.0) -> DataFrame:
    """Leading cities per country with drivers and matched actions."""
    cities = score.country_cities(weekly_scores, share, newbie_cost=newbie_cost)
    return score.match_playbook(cities, playbook)
