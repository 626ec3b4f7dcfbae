"""Who is active, who stopped, and when: snapshots, labels, anchors and booking gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.functions.common import (
    all_of,
    days_between,
    in_country,
    period_start,
    safe_div,
    segment_of,
    shift_back,
)
from stayrate.params import Params


def flatten_deliveries(orders_nested: DataFrame) -> DataFrame:
    """One row per delivery; orders without deliveries vanish."""
    return orders_nested.select("country_code", "created_date", F.explode("deliveries").alias("d")).select(
        "country_code",
        "created_date",
        F.col("d.rider_id").cast("string").alias("rider_id"),
        F.col("d.delivery_status").alias("delivery_status"),
        F.col("d.is_primary").alias("is_primary"),
        F.col("d.rider_dropped_off_at").alias("rider_dropped_off_at"),
    )


def completed_deliveries(orders_nested: DataFrame, p: Params) -> DataFrame:
    """Completed primary deliveries with a known rider and drop-off."""
    source = orders_nested
    country = in_country(p.country)
    if country is not None:
        source = source.where(country)
    return flatten_deliveries(source).where(
        F.col("rider_id").isNotNull()
        & (F.col("delivery_status") == "completed")
        & F.col("is_primary")
        & F.col("rider_dropped_off_at").isNotNull()
    )


def _in_window(c: str, p: Params) -> Column:
    return F.col(c).between(F.lit(p.start), F.lit(p.as_of))


def delivery_activity(orders_nested: DataFrame, p: Params) -> DataFrame:
    """First delivery day and eligibility per rider, both from one pass over the orders."""
    done = completed_deliveries(orders_nested, p)
    history = None if p.history_start is None else F.col("created_date") >= F.lit(p.history_start)
    return done.groupBy("rider_id").agg(
        F.min(F.when(all_of(history), F.to_date("rider_dropped_off_at"))).alias("first_delivery_date"),
        F.max(_in_window("created_date", p)).alias("eligible"),
    )


def eligible_entities(orders_nested: DataFrame, p: Params) -> DataFrame:
    """Distinct riders with a completed primary delivery inside the window."""
    return (
        completed_deliveries(orders_nested, p).where(_in_window("created_date", p)).select("rider_id").distinct()
    )


def only_eligible(rows: DataFrame, eligible: DataFrame) -> DataFrame:
    """Semi-join on the rider. Call it on aggregated rows, so that a heavy rider is one row."""
    return rows.join(eligible, "rider_id", "left_semi")


def entity_dates(attributes: DataFrame) -> DataFrame:
    """First and last order day, one row per rider even if the attribute table repeats riders."""
    return attributes.groupBy(F.col("rider_id").cast("string").alias("rider_id")).agg(
        F.max(F.to_date("first_order_creation_datetime")).alias("first_order_date"),
        F.max(F.to_date("last_order_creation_datetime")).alias("last_order_date"),
    )


def counted_slots(slots: DataFrame, p: Params) -> DataFrame:
    """Slots with a rider and start whose state counts as a booking."""
    return slots.where(
        all_of(
            in_country(p.country),
            F.col("rider_id").isNotNull(),
            F.col("shift_start_at").isNotNull(),
            F.col("shift_state").isin(*p.slot_states),
        )
    )


def last_slot(slots: DataFrame, p: Params) -> DataFrame:
    return (
        counted_slots(slots, p)
        .where(_in_window("created_date", p))
        .groupBy(F.col("rider_id").cast("string").alias("rider_id"))
        .agg(F.max(F.to_date("shift_start_at")).alias("last_slot_date"))
    )


def _label(first: Column, last: Column, p: Params) -> dict[str, Column]:
    as_of = F.lit(p.as_of)
    tenure = days_between(as_of, first)
    idle = days_between(as_of, last)
    segment = segment_of(tenure, p.newbie_days)
    limit = F.lit(p.churn_days)
    if p.newbie_churn_days is not None:
        limit = F.when(segment == "newbie", F.lit(p.newbie_churn_days)).otherwise(limit)
    churned = last.isNull() | (idle >= limit)
    return {
        "segment": segment,
        "tenure_days": tenure,
        "days_since_last_slot": F.coalesce(idle, tenure),
        "week_of_churn": F.when(last.isNull(), period_start(first, p.period)).when(
            churned, period_start(last, p.period)
        ),
        "is_churned": churned.cast("int"),
    }


def activity_snapshot(orders_nested: DataFrame, slots: DataFrame, p: Params, activity: DataFrame | None = None) -> DataFrame:
    """Eligible riders with segment, tenure, time since the last booking and churn label.

    A rider without any booking counts as churned since the first delivery. ``activity`` is what
    ``delivery_activity`` gives for the orders, where it is already there.
    """
    known = delivery_activity(orders_nested, p) if activity is None else activity
    riders = known.where(
        F.col("eligible") & F.col("first_delivery_date").isNotNull()
    )
    rows = riders.join(last_slot(slots, p), "rider_id", "left")
    first, last = F.col("first_delivery_date"), F.col("last_slot_date")
    out = _label(first, last, p)
    return rows.select(
        "rider_id",
        out["segment"].alias("segment"),
        period_start(first, p.period).alias("start_week_of_tenure"),
        out["tenure_days"].alias("tenure_days"),
        out["week_of_churn"].alias("week_of_churn"),
        out["days_since_last_slot"].alias("days_since_last_slot"),
        out["is_churned"].alias("is_churned"),
        out["is_churned"].alias("churn"),
    )


def churned_count(snapshot: DataFrame) -> DataFrame:
    return snapshot.where(F.col("is_churned") == 1).agg(
        F.countDistinct("rider_id").alias("churned_riders_in_timeframe")
    )


def rider_anchor(eligible: DataFrame, attributes: DataFrame, slots: DataFrame, p: Params) -> DataFrame:
    """Segment, churn period and anchor per eligible rider; tenure from the attribute table."""
    rows = eligible.join(entity_dates(attributes), "rider_id").join(last_slot(slots, p), "rider_id", "left")
    out = _label(F.col("first_order_date"), F.col("last_slot_date"), p)
    labelled = rows.select(
        "rider_id",
        "first_order_date",
        "last_order_date",
        out["segment"].alias("segment"),
        out["week_of_churn"].alias("week_of_churn"),
        out["is_churned"].alias("is_churned"),
    )
    return labelled.withColumn(
        "anchor_week", F.coalesce("week_of_churn", period_start(F.lit(p.as_of), p.period))
    )


def churned_riders(anchor: DataFrame) -> DataFrame:
    return anchor.where(F.col("is_churned") == 1).select("rider_id", "segment", "week_of_churn")


def relative_periods(anchor: DataFrame, p: Params) -> DataFrame:
    """Each rider with offsets 0..n-1 back from the anchor. The offsets are generated in place."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(p.n_periods - 1)))
    return anchor.select("*", steps.alias("week_offset")).withColumn(
        "feature_week", shift_back("anchor_week", F.col("week_offset"), p.period)
    )


def booking_days(slots: DataFrame, p: Params, since: Column | None = None) -> DataFrame:
    """Counted slots per rider and day.

    Everything about gaps follows from the distinct days and their slot counts, so a rider with very
    many slots is never more than one row per day in the window that follows.
    """
    day = F.to_date("shift_start_at")
    return (
        counted_slots(slots, p)
        .where(all_of(day <= F.lit(p.as_of), None if since is None else day >= since))
        .groupBy(F.col("rider_id").cast("string").alias("rider_id"), day.alias("day"))
        .agg(F.count(F.lit(1)).alias("n_slots"))
    )


def day_gaps(days: DataFrame) -> DataFrame:
    """Per rider and day: gap to the previous booking day and the number of gaps that end on the day.

    Slots on the same day are zero days apart, so a day with n slots ends n gaps, of which one is the
    gap to the previous day (none on the first day).
    """
    w = Window.partitionBy("rider_id").orderBy("day")
    gap = F.datediff(F.col("day"), F.lag("day").over(w))
    return days.select("rider_id", "day", "n_slots", gap.alias("gap")).withColumn(
        "n_gaps", F.col("n_slots") - F.when(F.col("gap").isNull(), F.lit(1)).otherwise(F.lit(0))
    )


def booking_gaps(slots: DataFrame, eligible: DataFrame, p: Params) -> DataFrame:
    """Mean and longest gap between bookings, by the period of the later one."""
    since = shift_back(F.lit(p.start), p.gap_lookback, p.period)
    days = only_eligible(booking_days(slots, p, since), eligible)
    gaps = day_gaps(days).where(F.col("n_gaps") > 0)
    return gaps.groupBy("rider_id", period_start("day", p.period).alias("week")).agg(
        safe_div(F.sum(F.coalesce("gap", F.lit(0))), F.sum("n_gaps")).alias("slot_gap_mean_days"),
        F.max(F.coalesce("gap", F.lit(0))).cast("bigint").alias("slot_gap_max_days"),
    )


def label_churn(slots: DataFrame, base: DataFrame, p: Params) -> DataFrame:
    """Label by segment: newbies may have a shorter limit than active riders.

    ``base`` has rider_id and tenure_days. A rider without bookings is churned.
    """
    as_of = F.lit(p.as_of)
    last = (
        counted_slots(slots, p)
        .where(F.to_date("shift_start_at") <= as_of)
        .groupBy(F.col("rider_id").cast("string").alias("rider_id"))
        .agg(F.max(F.to_date("shift_start_at")).alias("last_slot_date"))
    )
    segment = segment_of(F.col("tenure_days"), p.newbie_days)
    limit = F.when(segment == "newbie", F.lit(p.newbie_churn_days or p.churn_days)).otherwise(F.lit(p.churn_days))
    idle = days_between(as_of, "last_slot_date")
    return base.join(last, "rider_id", "left").select(
        "rider_id",
        (F.col("last_slot_date").isNull() | (idle >= limit)).cast("int").alias("is_churned"),
        idle.alias("days_since_last_booking"),
        segment.alias("segment"),
    )


def booking_patterns(slots: DataFrame, p: Params) -> DataFrame:
    """Bookings in the last 7, 14 and 28 days, their trends, recency and spread of the gaps."""
    gaps = day_gaps(booking_days(slots, p))
    age = F.datediff(F.lit(p.as_of), F.col("day"))

    def booked(lo: int, hi: int) -> Column:
        return F.sum(F.when((age >= lo) & (age < hi), F.col("n_slots")).otherwise(F.lit(0)))

    gap = F.coalesce(F.col("gap"), F.lit(0)).cast("double")
    n, s, q = F.sum("n_gaps"), F.sum(gap), F.sum(gap * gap)
    variance = safe_div(q - safe_div(s * s, n), n - 1)
    rows = gaps.groupBy("rider_id").agg(
        booked(0, 7).alias("slots_last_7d"),
        booked(0, 14).alias("slots_last_14d"),
        booked(0, 28).alias("slots_last_28d"),
        booked(7, 14).alias("prior_7d"),
        booked(14, 28).alias("prior_14d"),
        F.min(age).cast("bigint").alias("days_since_last_booking"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("booking_regularity_raw"),
        (n > 1).alias("has_spread"),
    )
    return rows.select(
        "rider_id",
        "slots_last_7d",
        "slots_last_14d",
        "slots_last_28d",
        safe_div(F.col("slots_last_7d") - F.col("prior_7d"), "prior_7d").alias("slots_trend_7d"),
        safe_div(F.col("slots_last_14d") - F.col("prior_14d"), "prior_14d").alias("slots_trend_14d"),
        "days_since_last_booking",
        F.when(F.col("has_spread"), F.col("booking_regularity_raw")).alias("booking_regularity"),
    )
