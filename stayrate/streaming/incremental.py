"""Incremental counts with Structured Streaming.

The queries run in update mode: each micro-batch writes only the groups it changed, into a folder
named after the batch. Writing a batch twice replaces the same folder, so a restart after a failure
does not double anything. The current state is the newest value per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stayrate.functions.rules import reason_label

# four days after the epoch (a Thursday) is a Monday
MONDAY = "4 days"
BATCH = "batch_no"


def ticket_counts(tickets: DataFrame, late: str | None = None) -> DataFrame:
    """Tickets per Monday week, rider and reason. All tickets count, however late, unless ``late`` sets a watermark."""
    flat = tickets.select(
        F.col("timestamp").cast("timestamp").alias("ts"),
        F.col("content.rider_id").cast("string").alias("rider_id"),
        reason_label(F.col("content.contact_reason_code")).alias("contact_reason_code"),
        F.col("content.action").alias("action"),
    ).where((F.col("action") == "Create") & F.col("rider_id").isNotNull())
    rows = flat if late is None else flat.withWatermark("ts", late)
    return (
        rows.groupBy(F.window("ts", "7 days", startTime=MONDAY), "rider_id", "contact_reason_code")
        .agg(F.count(F.lit(1)).alias("ticket_count"))
        .select(F.to_date("window.start").alias("week"), "rider_id", "contact_reason_code", "ticket_count")
    )


def last_activity(slots: DataFrame, states: Sequence[str]) -> DataFrame:
    """Newest booking day per rider."""
    return (
        slots.where(F.col("shift_state").isin(*states) & F.col("rider_id").isNotNull())
        .groupBy(F.col("rider_id").cast("string").alias("rider_id"))
        .agg(F.max(F.to_date("shift_start_at")).alias("last_slot_date"))
    )


def run_available(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived and stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    query = (
        changes.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


def current_state(spark: SparkSession, path: str, keys: Sequence[str], value: str) -> DataFrame:
    """The newest value of every key."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(value, BATCH).alias(value))


