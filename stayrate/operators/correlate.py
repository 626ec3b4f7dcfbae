"""Rider-level inputs of the correlation analysis and Pearson correlation with NULLs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.common import numeric_columns, present, safe_div, slug, to_number
from stayrate.functions.rules import CONTACT_TOP_N, CORRELATION_METRICS

NOT_CORRELATED = (
    "rider_id",
    "week",
    "segment",
    "hire_date",
    "first_delivery_date",
    "last_delivery_date",
    "last_active_week",
    "last_slot_date",
)


def rider_means(weekly: DataFrame, metrics: Sequence[str] = CORRELATION_METRICS) -> DataFrame:
    """Mean of every weekly measure per rider and the number of distinct weeks."""
    return weekly.groupBy(F.col("rider_id").cast("string").alias("rider_id")).agg(
        *[F.avg(to_number(m)).alias(m) for m in present(weekly, metrics)],
        F.countDistinct("week").alias("weeks_observed"),
    )


def contact_topn_pivot(reasons: DataFrame, n: int = CONTACT_TOP_N) -> DataFrame:
    """Tickets per rider: one column for each of the n largest reasons, the rest together, and the total."""
    count = to_number("ticket_count")
    ranked = (
        reasons.groupBy("contact_reason_code")
        .agg(F.sum(count).alias("total"))
        .orderBy(F.col("total").desc(), F.col("contact_reason_code"))
        .limit(n)
    )
    top = [r["contact_reason_code"] for r in ranked.collect()]
    bucket = F.when(F.col("contact_reason_code").isin(top), F.col("contact_reason_code")).otherwise(F.lit("other_reason"))
    names = [*top, *([] if "other_reason" in top else ["other_reason"])]
    wide = (
        reasons.select(F.col("rider_id").cast("string").alias("rider_id"), bucket.alias("bucket"), count.alias("c"))
        .groupBy("rider_id")
        .pivot("bucket", names)
        .agg(F.sum("c"))
    )
    filled = wide.select("rider_id", *[F.coalesce(F.col(f"`{b}`"), F.lit(0.0)).alias(f"contact_{b}") for b in names])
    return filled.withColumn("total_tickets", _row_sum([f"contact_{b}" for b in names]))


def violation_pivot(violations: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Violations per rider with one column per violation type and action.

    Without ``names`` the columns are found with one distinct pass over the aggregated rows.
    """
    label = F.concat(
        F.lit("compliance_"),
        slug(F.coalesce("violation_type", F.lit("unknown"))),
        F.lit("_"),
        slug(F.coalesce("action_type", F.lit("unknown"))),
    )
    rows = violations.groupBy(F.col("rider_id").cast("string").alias("rider_id"), label.alias("name")).agg(
        F.sum(to_number("violations_count")).alias("c")
    )
    if names is None:
        names = [r["name"] for r in rows.select("name").distinct().orderBy("name").collect()]
    wide = rows.groupBy("rider_id").pivot("name", list(names)).agg(F.sum("c"))
    filled = wide.select("rider_id", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in names])
    return filled.withColumn("total_violations", _row_sum(names))


def _row_sum(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in names], F.lit(0.0))


def ever_flag(labels: DataFrame) -> DataFrame:
    """Whether a rider was ever churned, and the mean tenure."""
    return labels.groupBy(F.col("rider_id").cast("string").alias("rider_id")).agg(
        F.max(to_number("is_churned")).cast("int").alias("is_churned"), F.avg(to_number("tenure_days")).alias("tenure_days")
    )


def churn_snapshot_columns(snapshot: DataFrame) -> DataFrame:
    """One row per rider from a snapshot; a repeated rider keeps the row with the smallest values."""
    cols = present(snapshot, ["is_churned", "tenure_days", "days_since_last_slot"])
    picked = snapshot.select(F.col("rider_id").cast("string").alias("rider_id"), *[to_number(c).alias(c) for c in cols])
    one = picked.groupBy("rider_id").agg(F.min(F.struct(*cols)).alias("r"))
    return one.select("rider_id", "r.*")


def exposure_normalise(counts: DataFrame, kpi: DataFrame) -> DataFrame:
    """Counts per observed day; a rider without observed weeks counts as one week."""
    days = kpi.select("rider_id", F.greatest(F.col("weeks_observed") * 7, F.lit(1)).alias("days_observed"))
    per = F.coalesce(F.col("days_observed"), F.lit(7))
    cols = [c for c in counts.columns if c != "rider_id"]
    joined = counts.join(days, "rider_id", "left")
    return joined.select("rider_id", *[safe_div(F.col(f"`{c}`"), per).alias(c) for c in cols])


def merge_riders(kpi: DataFrame, *others: DataFrame | None) -> DataFrame:
    """Left joins of the rider-level inputs that are given."""
    return reduce(lambda a, b: a.join(b, "rider_id", "left"), [o for o in others if o is not None], kpi)


def pearson(a: str, b: str) -> Column:
    """Pearson r over the rows where both are known; NULL when one of them is constant."""
    x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
    dev_x = F.stddev_pop(F.when(y.isNotNull(), x))
    dev_y = F.stddev_pop(F.when(x.isNotNull(), y))
    return safe_div(F.covar_pop(x, y), dev_x * dev_y)


def target_correlation(merged: DataFrame, target: str = "is_churned", features: Sequence[str] | None = None) -> DataFrame:
    """Features ranked by the size of their correlation with the target, from one aggregation."""
    cols = list(features) if features is not None else [c for c in numeric_columns(merged, NOT_CORRELATED) if c != target]
    wide = merged.agg(*[pearson(c, target).alias(c) for c in cols])
    long = wide.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("pearson_r")) for c in cols])
        )
    )
    return long.orderBy(F.abs("pearson_r").desc_nulls_last(), "feature")


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All pairs, in long form, from one aggregation."""
    names = list(features)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    wide = df.agg(*[pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(
                F.struct(F.lit(left).alias("feature_a"), F.lit(right).alias("feature_b"), F.col(f"r{i}").alias("pearson_r"))
            )
    return wide.select(F.inline(F.array(*cells)))
