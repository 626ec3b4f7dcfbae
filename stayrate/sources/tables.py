"""Scans, extracts and small reference sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.functions.common import all_of, first_present
from stayrate.functions.rules import owner_of


def filtered_scan(
    table: DataFrame,
    columns: Sequence[str],
    day: str,
    start: date,
    end: date,
    country: str | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """Columns of a table for one country and an inclusive date range, keys known.

    The range is a plain comparison on the stored column, so it reaches the file scan (and the
    partitions, where the table is partitioned by that day).
    """
    later = F.lit(end)
    return table.where(
        all_of(
            None if country is None else F.col("country_code") == F.lit(country),
            F.col(day) >= F.lit(start),
            F.col(day) < F.date_add(later, 1),
            *[F.col(c).isNotNull() for c in required],
        )
    ).select(*columns)


def series(spark: SparkSession, n: int, name: str = "k") -> DataFrame:
    """0..n-1 as rows."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; what does not fit becomes NULL."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)


def normalise_playbook(raw: DataFrame) -> DataFrame:
    """Action sheet rows: trimmed headers, blanks as ``Unknown``, rows without an action dropped, owner added."""
    sheet = raw.withColumnsRenamed({c: c.strip() for c in raw.columns})

    def text(name: str, default: str | None) -> Column:
        if name not in sheet.columns:
            return F.lit(default if default is not None else "")
        value = F.trim(F.col(f"`{name}`").cast("string"))
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(default)) if default is not None else F.coalesce(value, F.lit(""))

    number = F.col("row_no") if "row_no" in sheet.columns else F.monotonically_increasing_id()
    rows = sheet.select(
        number.cast("bigint").alias("row_no"),
        text("Impact", "Unknown").alias("impact"),
        text("Metrics", "Unknown").alias("metric"),
        text("Reasons to churn", None).alias("reason"),
        text("Action plan", None).alias("action"),
        text("Estimated cost of action plan", "Unknown").alias("estimated_cost"),
    )
    return rows.where(F.col("action") != "").withColumn("owner", owner_of(F.concat_ws(" ", "metric", "action")))


def read_playbook(spark: SparkSession, path: str) -> DataFrame:
    """The action sheet from CSV; the order of the rows is kept as row_no."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return normalise_playbook(raw)


def city_extract(
    table: DataFrame, city: str, as_of: date, day: str | None = None, lookback_days: int = 90, city_col: str = "city_code"
) -> DataFrame:
    """Rows of one city in the last ``lookback_days`` days (all days when the table has no day)."""
    recent = None if day is None else F.col(day) >= F.date_sub(F.lit(as_of), F.lit(lookback_days))
    return table.where(all_of(F.col(city_col) == F.lit(city), recent))


def courier_base_extract(
    table: DataFrame, city: str, as_of: date, lookback_days: int = 90, city_col: str = "city_code"
) -> DataFrame:
    """Couriers of a city hired in the last ``lookback_days`` days with at least one order."""
    tenure = F.datediff(F.lit(as_of), F.col("hire_date"))
    return table.where(
        (F.col(city_col) == F.lit(city)) & (tenure <= lookback_days) & (F.col("total_orders") >= 1)
    ).withColumn("tenure_days", tenure)


def first_rows(table: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """A repeatable row limit: the order is part of the call."""
    return table.orderBy(*order).limit(n)


def parameter_query(spark: SparkSession, sql: str, args: Mapping[str, object], **tables: DataFrame) -> DataFrame:
    """A SQL text with named parameters over the given tables."""
    return spark.sql(sql, args=dict(args), **tables)


def located(df: DataFrame) -> DataFrame:
    """Country and city from the first known column name, else a placeholder."""
    country = first_present(df, ("country_code", "country"), "UNKNOWN")
    city = first_present(df, ("city_code", "city", "city_name"), "UNKNOWN_CITY")
    return df.withColumns({"country_code": country, "city_code": city})
