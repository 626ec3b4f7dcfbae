"""Canonical roles derived from a star schema of customers, orders, line items and events.

The library works on nested order records, slots, shift rows, deliveries, payments, tickets,
compliance records and applications. Here each of them is derived row by row from the star schema, so
its size grows with the tables. Nested arrays are built inside a row, never by collecting rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stayrate.functions.rules import REASON_LABELS

COUNTRY = "ALL"
# Riders are dealt over so many countries where a query asks for one of them; three sources write the codes in their own way.
COUNTRIES = 3
CONTACT_CODE, TICKET_CODE, APPLICANT_CODE = "M{}", "AB_M{}", "M{}"

# Moves the events of January 2024 next to the last orders; 8218 days are whole weeks.
EVENT_SHIFT_DAYS = 8218


# Holidays with a fixed month and day.
FIXED_HOLIDAYS = {
    "01-01": "New Year Day",
    "01-06": "Epiphany",
    "05-01": "Labour Day",
    "05-03": "Constitution Day",
    "08-15": "Assumption Day",
    "11-01": "All Saints Day",
    "11-11": "Independence Day",
    "12-25": "Christmas Day",
    "12-26": "Second Day of Christmas",
}


@dataclass(frozen=True)
class Sources:
    """Canonical input tables."""

    orders_nested: DataFrame
    attributes: DataFrame
    slots: DataFrame
    kpi: DataFrame
    deliveries: DataFrame
    payments: DataFrame
    contacts: DataFrame
    tickets: DataFrame
    compliance: DataFrame
    applicants: DataFrame


class Star:
    """The tables of one folder. With ``split`` the riders belong to several countries, whose codes differ by source."""

    def __init__(self, spark: SparkSession, folder: str, split: bool = False):
        self.spark = spark
        self.split = split
        self.folder = folder.rstrip("/")
        self._schemas: dict[str, StructType] = {}

    def table(self, name: str) -> DataFrame:
        """A table of the folder. Its schema is read from the files once."""
        path = f"{self.folder}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def order_lines(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        return self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def homes(self) -> DataFrame:
        """Customer with nation and region names."""
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return (
            self.table("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "c_mktsegment", "c_acctbal", "n_name", "r_name")
        )

    def events(self) -> DataFrame:
        """Events with the number from their JSON text and the shifted time."""
        return self.table("events").select(
            "event_id",
            "event_type",
            "value",
            F.col("user_id").cast("string").alias("rider_id"),
            (F.col("ts") - F.expr(f"INTERVAL {EVENT_SHIFT_DAYS} DAYS")).alias("at"),
            F.col("ts"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )


def _country(star: Star, rider: str, form: str = "m{}") -> Column:
    """The code of a rider's country as a source writes it."""
    if not star.split:
        return F.lit(COUNTRY)
    ahead, after = form.split("{}")
    return F.concat(F.lit(ahead), (F.col(rider).cast("bigint") % COUNTRIES).cast("string"), F.lit(after))


def _rider() -> Column:
    return F.col("o_custkey").cast("string")


def orders_nested(star: Star) -> DataFrame:
    """Order records with none, one or two deliveries; the second is never the primary one."""

    def delivery(primary: Column) -> Column:
        return F.struct(
            _rider().alias("rider_id"),
            F.when(F.col("l_linestatus") == "F", F.lit("completed")).otherwise(F.lit("cancelled")).alias("delivery_status"),
            primary.alias("is_primary"),
            F.col("l_shipdate").alias("rider_dropped_off_at"),
        )

    both = F.array(delivery(F.col("l_linenumber") == 1), delivery(F.lit(False)))
    size = F.when(F.col("l_quantity") < 2, 0).when(F.col("l_quantity") > 40, 2).otherwise(1)
    return star.order_lines().select(
        _country(star, "o_custkey").alias("country_code"),
        F.to_date("o_orderdate").alias("created_date"),
        F.slice(both, F.lit(1), size).alias("deliveries"),
    )


def attributes(star: Star) -> DataFrame:
    return (
        star.table("orders")
        .groupBy(F.col("o_custkey").cast("string").alias("rider_id"))
        .agg(
            F.min("o_orderdate").alias("first_order_creation_datetime"),
            F.max("o_orderdate").alias("last_order_creation_datetime"),
        )
    )


def slots(star: Star) -> DataFrame:
    state = (
        F.when(F.col("o_orderstatus") == "F", "EVALUATED").when(F.col("o_orderstatus") == "O", "PUBLISHED").otherwise("OTHER")
    )
    return star.table("orders").select(
        _country(star, "o_custkey").alias("country_code"),
        _rider().alias("rider_id"),
        F.to_date("o_orderdate").alias("created_date"),
        F.col("o_orderdate").alias("shift_start_at"),
        state.alias("shift_state"),
    )


def daily_kpi(star: Star) -> DataFrame:
    def flag(letter: str) -> Column:
        return (F.col("l_returnflag") == letter).cast("bigint")

    # the homes meet the orders, of which there are fewer than lines
    orders = star.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    placed = orders.join(star.homes(), F.col("o_custkey") == F.col("c_custkey"))
    return (
        star.table("lineitem")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            _country(star, "o_custkey").alias("country_code"),
            _rider().alias("rider_id"),
            F.col("n_name").alias("city_name"),
            F.col("c_mktsegment").alias("vehicle_name"),
            F.col("l_linenumber").alias("batch_number"),
            F.to_date("o_orderdate").alias("created_date_local"),
            flag("R").alias("no_shows"),
            flag("A").alias("shifts_done"),
            F.lit(1).cast("bigint").alias("all_shifts"),
            (F.col("l_quantity") * 360).alias("working_time"),
        )
    )


def deliveries(star: Star) -> DataFrame:
    day = F.to_date("o_orderdate")
    return star.order_lines().select(
        _country(star, "o_custkey").alias("country_code"),
        _rider().alias("rider_id"),
        F.col("l_orderkey").alias("order_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("delivery_id"),
        F.col("l_orderkey").alias("global_order_id"),
        F.col("o_orderpriority").alias("zone_name"),
        day.alias("report_date"),
        day.alias("creation_date_local"),
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("cancelled").alias("delivery_status"),
        (F.col("l_linenumber") - 1).alias("total_stacked_deliveries"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity") * 100).alias("pickup_distance_google_in_meters"),
        (F.col("l_extendedprice") / 10).alias("dropoff_distance_google_in_meters"),
        F.when(F.col("l_returnflag") == "A", "auto").alias("auto_transition_dropoff"),
        (F.col("l_discount") * 6000).alias("at_customer_time_in_seconds"),
        F.when(F.col("l_tax") > 0, F.col("l_shipdate")).alias("rider_near_restaurant_at"),
        F.when(F.col("l_discount") != 0, F.col("l_quantity") * 20).alias("at_vendor_time_in_seconds"),
        (F.col("l_quantity") * 60).alias("courier_delivery_time_in_seconds"),
        (F.col("l_returnflag") == "R").cast("bigint").alias("total_reassignments"),
        F.lit(1).cast("bigint").alias("total_deliveries"),
    )


def payments(star: Star) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    pay = F.col("o_totalprice") / 1000
    return (
        star.table("orders")
        .join(star.homes(), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            _country(star, "o_custkey").alias("country_code"),
            F.col("o_orderkey").alias("global_order_id"),
            F.col("n_name").alias("city_code"),
            F.when(status == "F", "DeliveredStatus")
            .when((status == "O") & (priority == "1-URGENT"), "cancelled")
            .when(status == "O", "delivered")
            .alias("order_final_status"),
            F.when(priority != "4-NOT SPECIFIED", priority != "2-HIGH").alias("is_dh_data"),
            (priority != "3-MEDIUM").alias("order_is_standard"),
            F.lit(1).cast("bigint").alias("primary_delivery_count"),
            pay.alias("total_compensation_local_currency"),
            F.when(priority == "1-URGENT", pay * 0.06).when(priority != "5-LOW", 0.0).alias("rain_bonus_cost_local_currency"),
            F.when(priority == "2-HIGH", pay * 0.02).otherwise(0.0).alias("snow_bonus_cost_local_currency"),
        )
    )


def contacts(star: Star) -> DataFrame:
    return star.events().select(
        _country(star, "rider_id", CONTACT_CODE).alias("country_code"),
        F.col("rider_id").alias("stakeholder_id"),
        F.col("at").alias("creation_timestamp"),
        F.when(F.col("k") % 10 != 0, F.col("value")).alias("sat_score"),
    )


def reason_code(k: Column) -> Column:
    """The first numbers are known codes, the next ones unknown codes, the rest has none."""
    known = F.array(*[F.lit(c) for c in REASON_LABELS])
    return F.when(k < len(REASON_LABELS), F.get(known, k)).when(k < 80, F.concat(F.lit("K"), (k % 6).cast("string")))


def ticket_stream(star: Star) -> DataFrame:
    return star.events().select(F.col("at").alias("timestamp"), ticket_content(_country(star, "rider_id", TICKET_CODE)).alias("content"))


def ticket_content(entity: Column | None = None) -> Column:
    return F.struct(
        F.col("rider_id"),
        reason_code(F.col("k")).alias("contact_reason_code"),
        (F.lit(COUNTRY) if entity is None else entity).alias("global_entity_id"),
        F.when(F.col("event_type") == "view", "Update").otherwise("Create").alias("action"),
    )


def compliance(star: Star) -> DataFrame:
    """Error events as records with one violation, none to two actions and one or two rules.

    Every eleventh number has no violation at all.
    """
    k = F.col("k")
    actions = F.array(*[F.struct(F.lit(t).alias("type")) for t in ("warning", "Temp block")])
    rules = F.array(
        F.struct(F.concat(F.lit("Type "), (k % 4).cast("string")).alias("violation_type")),
        F.struct(F.lit("GPS-spoof").alias("violation_type")),
    )
    violation = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.slice(actions, F.lit(1), k % 3).alias("actions"),
        F.slice(rules, F.lit(1), 1 + k % 2).alias("rules"),
    )
    return (
        star.events()
        .where(F.col("event_type") == "error")
        .select(
            _country(star, "rider_id").alias("country_code"),
            "rider_id",
            F.col("at").alias("created_at"),
            F.to_date("at").alias("created_date"),
            F.slice(F.array(violation), F.lit(1), F.when(k % 11 == 0, 0).otherwise(1)).alias("violations"),
        )
    )


def applicants(star: Star) -> DataFrame:
    k = F.col("k")
    source = F.when(k % 7 != 0, F.concat(F.lit("source_"), (k % 5).cast("string")))
    return (
        star.events()
        .where(F.col("event_type") == "signup")
        .select(
            _country(star, "rider_id", APPLICANT_CODE).alias("country_code"),
            "rider_id",
            F.col("at").alias("created_at"),
            F.struct(F.struct(source.alias("source")).alias("utm")).alias("custom_non_pii_fields"),
        )
    )


def sources(star: Star) -> Sources:
    return Sources(
        orders_nested(star),
        attributes(star),
        slots(star),
        daily_kpi(star),
        deliveries(star),
        payments(star),
        contacts(star),
        ticket_stream(star),
        compliance(star),
        applicants(star),
    )


def scores(star: Star) -> DataFrame:
    """Events as labelled scores: errors are positive, the value is the score."""
    return star.table("events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("p"),
        F.date_trunc("week", "ts").cast("date").alias("event_week"),
        (F.col("user_id") % 3).cast("string").alias("segment"),
    )


def scored_riders(star: Star) -> DataFrame:
    """Customers as scored riders with a handful of weekly-style features."""
    lines = (
        star.order_lines()
        .groupBy("o_custkey")
        .agg(
            F.countDistinct("o_orderkey").alias("total_orders_cpo_W0"),
            F.sum((F.col("l_returnflag") == "R").cast("bigint")).alias("no_shows_W0"),
            F.sum("l_quantity").alias("hours_worked_W0"),
            F.avg("l_extendedprice").alias("avg_sp_distance_google_W0"),
            F.avg(F.col("l_linenumber").cast("double")).alias("perc_stacking_W0"),
            F.avg("l_discount").alias("contacts_total_tickets_W0"),
            F.avg("l_tax").alias("cdt_wow_delta_W0_W1"),
        )
    )
    pay = star.table("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total_earnings_W0"))
    p = F.least(F.greatest((F.col("c_acctbal") + 1000) / 11000, F.lit(0.0)), F.lit(1.0))
    return (
        star.homes()
        .join(lines, F.col("c_custkey") == lines["o_custkey"], "left")
        .drop("o_custkey")
        .join(pay, F.col("c_custkey") == pay["o_custkey"], "left")
        .select(
            F.col("c_custkey").cast("string").alias("rider_id"),
            F.col("r_name").alias("country_code"),
            F.col("n_name").alias("city_code"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "newbie").otherwise("active").alias("segment"),
            F.floor(F.col("c_acctbal")).cast("bigint").alias("tenure_days"),
            p.alias("churn_probability"),
            (F.col("c_acctbal") > 8000).cast("int").alias("is_churned"),
            "total_orders_cpo_W0",
            "no_shows_W0",
            "hours_worked_W0",
            "avg_sp_distance_google_W0",
            "perc_stacking_W0",
            "contacts_total_tickets_W0",
            "cdt_wow_delta_W0_W1",
            "total_earnings_W0",
            F.lit(1).alias("holiday_days_in_week_W0"),
        )
    )


def playbook_sheet(star: Star) -> DataFrame:
    """Parts as rows of an action sheet; names repeat, costs and metrics vary, some fields are blank."""
    metrics = F.array(
        *[
            F.lit(m)
            for m in (
                "Earnings per hour",
                "slot_gap",
                "contacts",
                "distance",
                "no_shows",
                "bw_orders",
                "hours",
                "batch",
                "",
            )
        ]
    )
    costs = F.array(*[F.lit(c) for c in (" Low", "medium ", "High", "")])
    return star.table("part").select(
        F.col("p_partkey").alias("row_no"),
        F.col("p_type").alias(" Impact"),
        F.get(metrics, (F.col("p_partkey") % 9).cast("int")).alias("Metrics "),
        F.col("p_brand").alias("Reasons to churn"),
        F.when(F.col("p_size") % 13 != 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.lit("  ")).alias("Action plan"),
        F.get(costs, (F.col("p_size") % 4).cast("int")).alias("Estimated cost of action plan"),
    )


def order_day_calendar(star: Star) -> DataFrame:
    """Order days that fall on a holiday with a fixed month and day."""
    named = F.create_map(*[F.lit(x) for md, n in FIXED_HOLIDAYS.items() for x in (md, n)])
    days = star.table("orders").select(F.to_date("o_orderdate").alias("holiday_date")).distinct()
    return days.withColumn("holiday_name", F.try_element_at(named, F.date_format("holiday_date", "MM-dd"))).where(
        F.col("holiday_name").isNotNull()
    )


# ---- plain rider tables for the lifetime features ------------------------------------------------


def rider_orders(star: Star) -> DataFrame:
    reasons = F.array(*[F.lit(r) for r in ("courier", "customer", "vendor", "tech")])
    return star.order_lines().select(
        _rider().alias("courier_id"),
        F.col("l_orderkey").alias("order_id"),
        F.to_date("o_orderdate").alias("order_date"),
        (F.col("l_extendedprice") / 100).alias("earnings"),
        (F.col("l_linenumber") > 1).alias("is_stacked"),
        (F.col("l_tax") > 0.05).alias("is_rush_bonus"),
        (F.col("l_tax") < 0.015).alias("is_bad_weather"),
        (F.col("l_returnflag") == "R").alias("is_reassigned"),
        (F.col("l_discount") > 0.085).alias("is_undelivered"),
        (F.col("l_linestatus") == "O").alias("is_failed"),
        F.when(F.col("l_linestatus") == "O", F.get(reasons, F.col("l_linenumber") % 4)).alias("fail_reason"),
        (F.col("l_quantity") / 10).alias("total_distance_km"),
        (F.col("l_quantity") / 30).alias("start_to_pickup_distance_km"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity") / 15).alias("pickup_to_delivery_distance_km"),
        (F.col("l_quantity") * 2).alias("delivery_time_minutes"),
        (F.col("l_discount") * 100).alias("waiting_time_pickup_minutes"),
        (F.col("l_tax") * 100).alias("waiting_time_delivery_minutes"),
        F.col("l_linenumber").cast("double").alias("batch_number"),
    )


def rider_slots(star: Star) -> DataFrame:
    """Orders as slots that start at an hour and last some hours."""
    hour = (F.col("o_orderkey") % 24).cast("int")
    length = (1 + F.col("o_orderkey") % 5).cast("int")
    start = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)
    return star.table("orders").select(
        _rider().alias("courier_id"),
        F.to_date("o_orderdate").alias("slot_date"),
        start.alias("slot_start_time"),
        (start + F.make_dt_interval(F.lit(0), length)).alias("slot_end_time"),
        (F.col("o_orderstatus") == "P").alias("was_no_show"),
    )


def rider_contacts(star: Star) -> DataFrame:
    k = F.col("k")
    return star.events().select(
        F.col("rider_id").alias("courier_id"),
        F.to_date("at").alias("contact_date"),
        F.when(k % 9 != 0, F.concat(F.lit("reason_"), (k % 9).cast("string"))).alias("contact_reason"),
        F.when(k % 3 == 0, "negative").when(k % 3 == 1, "resolved").otherwise("open").alias("contact_outcome"),
        F.when(k % 10 != 0, F.col("value")).alias("rsat_score"),
    )


def rider_violations(star: Star) -> DataFrame:
    return (
        star.events()
        .where(F.col("event_type") == "error")
        .select(
            F.col("rider_id").alias("courier_id"),
            F.to_date("at").alias("violation_date"),
            F.concat(F.lit("Type "), (F.col("k") % 4).cast("string")).alias("violation_type"),
        )
    )


def rider_base(star: Star) -> DataFrame:
    first = star.table("orders").groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("hire_date"), F.count(F.lit(1)).alias("total_orders")
    )
    return (
        star.homes()
        .join(first, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            F.col("c_custkey").cast("string").alias("courier_id"),
            F.col("n_name").alias("city"),
            "hire_date",
            "total_orders",
            F.col("c_mktsegment").alias("vehicle_type"),
            F.concat(F.lit("channel_"), (F.col("c_custkey") % 3).cast("string")).alias("onboarding_channel"),
        )
    )


def rider_balances(star: Star) -> DataFrame:
    return star.table("customer").select(
        F.col("c_custkey").cast("string").alias("courier_id"), F.col("c_acctbal").alias("cash_balance")
    )
