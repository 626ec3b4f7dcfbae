"""Aggregates per rider and period: shifts, deliveries and pay, tickets, violations, peers, calendar.

Rows are aggregated before any filter on riders, so a rider with a third of all rows is combined on
the map side and reaches the shuffle as one row per period and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.functions.common import all_of, in_country, period_start, safe_div, shift_back
from stayrate.functions.ordering import durable, group_quantiles
from stayrate.functions.rules import HOLIDAYS, reason_label
from stayrate.params import Params


def _since(p: Params) -> Column:
    return shift_back(F.lit(p.start), p.kpi_lookback, p.period)


def _window(day: Column, p: Params) -> Column:
    return (day >= _since(p)) & (day <= F.lit(p.as_of))


def _rider(c: str = "rider_id") -> Column:
    return F.col(c).cast("string").alias("rider_id")


def weekly_shift_kpis(kpi: DataFrame, p: Params) -> DataFrame:
    """Shift counts, hours and no-show share per rider and period.

    City and vehicle are keys of a first, purely numeric aggregation. A maximum of a text column
    would turn the pass over the raw rows into a sort; here it only sees the few rows that are left.
    """
    day = F.to_date("created_date_local")
    rows = kpi.where(all_of(in_country(p.country), F.col("rider_id").isNotNull(), _window(day, p)))
    first = rows.groupBy(_rider(), period_start(day, p.period).alias("week"), "city_name", "vehicle_name").agg(
        F.max("batch_number").alias("batch_number"),
        *[F.sum(c).alias(c) for c in ("no_shows", "shifts_done", "all_shifts", "working_time")],
    )
    return first.groupBy("rider_id", "week").agg(
        F.max("city_name").alias("city_name"),
        F.max("vehicle_name").alias("vehicle_name"),
        F.max("batch_number").alias("batch_number"),
        F.sum("no_shows").alias("no_shows"),
        F.sum("shifts_done").alias("shifts_done"),
        F.sum("all_shifts").alias("all_shifts"),
        (F.sum("working_time") / F.lit(p.seconds_per_hour)).alias("hours_worked"),
        safe_div(F.sum("no_shows"), F.sum("all_shifts")).alias("perc_no_show"),
    )


def paid_deliveries(deliveries: DataFrame, payments: DataFrame, day: str, p: Params) -> DataFrame:
    """Deliveries in the window with the payment of their order; unpaid deliveries drop out."""
    d = deliveries.where(
        all_of(in_country(p.country), F.col("rider_id").isNotNull(), _window(F.to_date(day), p))
    ).drop("country_code")
    r = payments if p.country is None else payments.where(in_country(p.country))
    return d.join(r, "global_order_id")


def _done() -> Column:
    """Order counts as delivered. An unknown status or flag leaves the answer unknown."""
    return ((F.col("order_final_status") != "cancelled") & F.col("is_dh_data")) | (
        (F.col("order_final_status") == "DeliveredStatus") & F.col("order_is_standard")
    )


def delivery_sums(rows: DataFrame, keys: list[Column | str], vendor_rows_need_seconds: bool = False) -> DataFrame:
    """Numeric sums per key and bad-weather order, in one hash aggregation over the raw rows.

    Pay repeats on every delivery of an order. ``bw_order`` is NULL except for completed orders with a
    weather bonus, so nearly all rows of a key fall into one group.
    """
    pay = F.col("total_compensation_local_currency")
    rain, snow = F.col("rain_bonus_cost_local_currency"), F.col("snow_bonus_cost_local_currency")
    completed = F.col("delivery_status") == "completed"
    customer = F.when(
        F.col("auto_transition_dropoff").isNull() & (F.col("at_customer_time_in_seconds") > 0),
        F.col("at_customer_time_in_seconds") / F.lit(60.0),
    )
    near = F.col("rider_near_restaurant_at").isNotNull()
    vendor = F.when(near, F.col("at_vendor_time_in_seconds") / F.lit(60.0))
    pickup, dropoff = F.col("pickup_distance_google_in_meters"), F.col("dropoff_distance_google_in_meters")
    means = {
        "pickup": pickup,
        "dropoff": dropoff,
        "both": dropoff + pickup,
        "customer": customer,
        "courier": F.col("courier_delivery_time_in_seconds"),
    }
    return rows.groupBy(*keys, F.when(((rain + snow) > 0) & completed, F.col("order_id")).alias("bw_order")).agg(
        F.sum(F.when(_done(), F.col("primary_delivery_count"))).alias("orders"),
        F.sum(pay).alias("pay"),
        F.sum(pay - rain - snow).alias("net"),
        # counted by whether the id is known, so that an id that is put together need not be
        F.count(F.when(completed & (F.col("total_stacked_deliveries") >= 1) & F.col("delivery_id").isNotNull(), F.lit(1))).alias("stacked"),
        F.count("delivery_id").alias("rows"),
        *[f(v).alias(f"{n}_{k}") for n, v in means.items() for f, k in ((F.sum, "s"), (F.count, "n"))],
        F.sum(vendor).alias("vendor_s"),
        F.count(vendor if vendor_rows_need_seconds else F.when(near, F.lit(1))).alias("vendor_n"),
        F.sum("total_reassignments").alias("reassigned"),
        F.sum("total_deliveries").alias("deliveries"),
    )


def delivery_measures(bw_orders: Column) -> list[Column]:
    """The published measures from the sums."""

    def mean(name: str, scale: float) -> Column:
        return safe_div(F.sum(f"{name}_s"), F.sum(f"{name}_n")) / F.lit(scale)

    orders = F.sum("orders")
    return [
        orders.alias("total_orders_cpo"),
        bw_orders.alias("total_bw_orders"),
        F.sum("pay").alias("total_earnings"),
        safe_div(F.sum("pay"), orders).alias("cpo_local_currency"),
        safe_div(F.sum("net"), orders).alias("net_cpo_lc"),
        safe_div(F.sum("stacked"), F.sum("rows")).alias("perc_stacking"),
        mean("pickup", 1000.0).alias("avg_sp_distance_google"),
        mean("dropoff", 1000.0).alias("avg_pd_distance_google"),
        mean("both", 1000.0).alias("avg_total_distance_google"),
        mean("customer", 1.0).alias("at_customer_time_in_minutes"),
        mean("vendor", 1.0).alias("at_vendor_time_in_minutes"),
        mean("courier", 60.0).alias("cdt"),
        safe_div(F.sum("reassigned"), F.sum("deliveries")).alias("perc_reas"),
    ]


def weekly_delivery_economics(
    deliveries: DataFrame, payments: DataFrame, p: Params, dedupe_orders: bool = False
) -> DataFrame:
    """Orders, pay, cost per order, distances and times per rider and period.

    ``dedupe_orders`` counts the pay of an order once per rider and period, on its first delivery
    (smallest delivery id), instead of once per delivery.
    """
    rows = paid_deliveries(deliveries, payments, "report_date", p).withColumn(
        "week", period_start(F.to_date("report_date"), p.period)
    )
    if dedupe_orders:
        rows = _pay_once(rows)
    sums = delivery_sums(rows, [_rider(), "week", "city_code", "zone_name"]).repartition("rider_id", "week")
    # Maxima of texts and a distinct count beside the sums would shuffle and sort all rows twice more. Here windows
    # put the largest texts on every row of a period and count an order where it comes first; the sums stay numeric.
    w = Window.partitionBy("rider_id", "week")
    again = F.lag("bw_order").over(w.orderBy("bw_order")) == F.col("bw_order")
    named = sums.withColumn("bw_first", (F.col("bw_order").isNotNull() & ~F.coalesce(again, F.lit(False))).cast("bigint"))
    named = named.withColumns({c: F.max(c).over(w) for c in ("city_code", "zone_name")})
    return named.groupBy("rider_id", "week", "city_code", "zone_name").agg(*delivery_measures(F.sum("bw_first")))


def _pay_once(rows: DataFrame) -> DataFrame:
    """Keep the pay columns on one delivery per (rider, period, order) and blank them on the others."""
    key = ["rider_id", "week", "global_order_id"]
    first = rows.groupBy(*key).agg(F.min("delivery_id").alias("__first"))
    money = (
        "primary_delivery_count",
        "total_compensation_local_currency",
        "rain_bonus_cost_local_currency",
        "snow_bonus_cost_local_currency",
    )
    keep = F.col("delivery_id") == F.col("__first")
    joined = rows.join(first, key)
    return joined.withColumns({m: F.when(keep, F.col(m)) for m in money}).drop("__first")


def weekly_kpi_variant(deliveries: DataFrame, payments: DataFrame, kpi: DataFrame, p: Params) -> DataFrame:
    """Delivery measures by country, city, zone, rider and period with the shift figures of the rider.

    Shift rows are first brought to one row per rider and period, so they cannot multiply deliveries.
    """
    p = p.but(kpi_lookback=0)
    shifts = weekly_shift_kpis(kpi, p).select(
        "rider_id", "week", "no_shows", "shifts_done", "all_shifts", "hours_worked", "perc_no_show"
    )
    day = F.to_date("creation_date_local")
    # the country comes with the payment row here, so the filter on deliveries is left out
    rows = paid_deliveries(deliveries, payments, "creation_date_local", p.but(country=None))
    country = in_country(p.country)
    if country is not None:
        rows = rows.where(country)
    rows = rows.withColumn("week", period_start(day, p.period)).withColumn("rider_id", F.col("rider_id").cast("string"))
    keys = ["country_code", "city_code", "zone_name", "rider_id", "week"]
    sums = delivery_sums(rows, list(keys), vendor_rows_need_seconds=True)
    measured = sums.groupBy(*keys).agg(*delivery_measures(F.count("bw_order")))
    return measured.join(shifts, ["rider_id", "week"], "left").select(
        *keys,
        *[c for c in measured.columns if c not in keys],
        safe_div("total_earnings", "hours_worked").alias("earning_per_hour"),
        *[F.col(c).cast("double").alias(c) for c in ("no_shows", "shifts_done", "all_shifts")],
        "hours_worked",
        "perc_no_show",
    )


def weekly_tickets(contacts: DataFrame, p: Params) -> DataFrame:
    """Scored tickets per rider and period, with their mean score."""
    day = F.to_date("creation_timestamp")
    rows = contacts.where(
        all_of(
            in_country(p.country_of("contacts")),
            F.col("sat_score").isNotNull(),
            F.col("stakeholder_id").isNotNull(),
            _window(day, p),
        )
    )
    return rows.groupBy(_rider("stakeholder_id"), period_start(day, p.period).alias("week")).agg(
        F.count(F.lit(1)).alias("contacts_total_tickets"), F.avg("sat_score").alias("avg_sat_score")
    )


def created_tickets(tickets: DataFrame, p: Params) -> DataFrame:
    """Newly created tickets after the start of the window, flattened."""
    flat = tickets.select(
        F.col("timestamp").alias("ts"),
        F.col("content.rider_id").cast("string").alias("rider_id"),
        F.col("content.contact_reason_code").alias("code"),
        F.col("content.global_entity_id").alias("entity"),
        F.col("content.action").alias("action"),
    )
    return flat.where(
        all_of(
            F.col("ts") > F.lit(p.start),
            in_country(p.country_of("tickets"), "entity"),
            F.col("action") == "Create",
            F.col("rider_id").isNotNull(),
        )
    )


def ticket_reasons(tickets: DataFrame, p: Params) -> DataFrame:
    """Tickets per rider, period and reason label."""
    return (
        created_tickets(tickets, p)
        .groupBy(
            "rider_id",
            period_start(F.to_date("ts"), p.period).alias("week"),
            reason_label(F.col("code")).alias("contact_reason_code"),
        )
        .agg(F.count(F.lit(1)).alias("ticket_count"))
    )


def flatten_violations(compliance: DataFrame, *keep: str) -> DataFrame:
    """Violation x action x rule. A violation without actions or without rules has no row."""
    v = compliance.select(*keep, F.explode("violations").alias("v"))
    a = v.select(*keep, "v", F.explode("v.actions").alias("a"))
    return a.select(*keep, F.col("v.id").alias("violation_id"), F.col("a.type").alias("action_type"), F.explode("v.rules").alias("r")).select(
        *keep, "violation_id", "action_type", F.col("r.violation_type").alias("violation_type")
    )


def weekly_violations(compliance: DataFrame, p: Params) -> DataFrame:
    """Distinct violations and violation types per rider and period.

    The date filter reads created_date, the period comes from created_at. Actions only decide whether
    a violation counts, so their number does not multiply the rows.
    """
    rows = compliance.where(all_of(in_country(p.country), _window(F.to_date("created_date"), p)))
    v = rows.select("rider_id", "created_at", F.explode("violations").alias("v")).where(F.size("v.actions") > 0)
    r = v.select("rider_id", "created_at", F.col("v.id").alias("id"), F.explode("v.rules").alias("r"))
    return r.groupBy(_rider(), period_start(F.to_date("created_at"), p.period).alias("week")).agg(
        F.countDistinct("id").alias("compliance_total_violations"),
        F.countDistinct("r.violation_type").alias("compliance_distinct_violation_types"),
    )


def violations_by_type_action(compliance: DataFrame, p: Params) -> DataFrame:
    """Distinct violations per rider, period, violation type and action."""
    rows = compliance.where(all_of(in_country(p.country), F.col("created_at") >= F.lit(p.start)))
    return (
        flatten_violations(rows, "rider_id", "created_date")
        .groupBy(
            _rider(), period_start("created_date", p.period).alias("week"), "violation_type", "action_type"
        )
        .agg(F.countDistinct("violation_id").alias("violations_count"))
    )


def city_benchmark(delivery_weekly: DataFrame, shift_weekly: DataFrame) -> DataFrame:
    """Median earnings per hour and mean earnings per city and period.

    The median is exact, the lower of two in the middle; a city with very many riders needs no more memory.
    """
    hours = shift_weekly.select("rider_id", "week", "hours_worked")
    rows = delivery_weekly.where(F.col("city_code").isNotNull()).join(hours, ["rider_id", "week"], "left")
    rates = durable(rows.select("city_code", "week", "total_earnings", safe_div("total_earnings", "hours_worked").alias("rate")))
    mean = F.avg("total_earnings").alias("city_avg_total_earnings")
    return group_quantiles(rates, ["city_code", "week"], "rate", 0.5, "city_median_earnings_per_hour", mean)


def acquisition_source(applicants: DataFrame, country: str | None = None) -> DataFrame:
    """First application day and source of the newest application, even if that source is missing."""
    rows = applicants.where(all_of(in_country(country), F.col("rider_id").isNotNull()))
    source = F.col("custom_non_pii_fields.utm.source")
    return rows.groupBy(_rider()).agg(
        F.min(F.to_date("created_at")).alias("registration_date"),
        F.max_by(source, F.struct("created_at", source)).alias("utm_source"),
    )


def holiday_calendar(spark, days=HOLIDAYS) -> DataFrame:
    """The fixed calendar as rows."""
    rows = F.array(*[F.struct(F.lit(d).alias("holiday_date"), F.lit(n).alias("holiday_name")) for d, n in days])
    return spark.range(1).select(F.inline(rows))


def holiday_weeks(calendar: DataFrame, p: Params) -> DataFrame:
    return calendar.groupBy(period_start("holiday_date", p.period).alias("week")).agg(
        F.count(F.lit(1)).alias("holiday_days_in_week")
    )
