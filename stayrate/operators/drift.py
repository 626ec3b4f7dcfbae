"""Label rates and feature drift between periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayrate.functions.common import finite, numeric_columns


def label_rate(df: DataFrame, week: str = "event_week", label: str = "is_churned", by: Sequence[str] = ()) -> DataFrame:
    """Rows and positive rate per period, optionally per further keys."""
    return df.where(F.col(week).isNotNull()).groupBy(F.col(week).alias("event_week"), *by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("positive_rate")
    )


def feature_drift(
    df: DataFrame,
    week: str = "event_week",
    label: str = "is_churned",
    by: Sequence[str] = (),
    features: Sequence[str] | None = None,
) -> DataFrame:
    """How far the feature means moved since the previous period.

    All means come from one aggregation; what follows has one row per period, key and feature.
    """
    cols = list(features) if features is not None else numeric_columns(df, (label, *by))
    known = df.where(F.col(week).isNotNull())
    means = known.groupBy(F.col(week).alias("event_week"), *by).agg(*[F.avg(finite(c)).alias(c) for c in cols])
    long = means.unpivot(["event_week", *by], cols, "feature", "mean")
    w = Window.partitionBy(*by, "feature").orderBy("event_week")
    moves = long.select(
        "event_week",
        *by,
        F.abs(F.col("mean") - F.lag("mean").over(w)).alias("move"),
        F.row_number().over(w).alias("nth"),
    )
    return (
        moves.where(F.col("nth") > 1)
        .groupBy("event_week", *by)
        .agg(
            F.count("move").alias("feature_count_compared"),
            F.avg("move").alias("feature_drift_mean_abs"),
            F.max("move").alias("feature_drift_max_abs"),
        )
    )
