"""Independent SQL for the registered queries.

The statements are written from the definitions, over the raw tables, in a dialect that DuckDB runs.
They use plain windows and joins where the library uses distributed forms.
"""

from __future__ import annotations

from stayrate.functions.rules import (
    CATEGORY_KEYWORDS,
    COST_BONUS,
    DELTA_METRICS,
    DRIVER_OF_FEATURE,
    DRIVER_PLAYBOOK,
    OWNER_KEYWORDS,
    PER_ORDER_METRICS,
    PROTECTIVE_KEYWORDS,
    REASON_LABELS,
    THRESHOLD_QUANTILES,
    TOPIC_KEYWORDS,
    WEEKLY_METRICS,
)
from stayrate.sources.roles import FIXED_HOLIDAYS

AS_OF = "DATE '2001-08-01'"
START = "DATE '1995-01-01'"

_SQL: dict[str, str] = {}


def statements() -> dict[str, str]:
    return dict(_SQL)


def rounded(expr: str) -> str:
    """Six places. The small shift puts exact halves on the same side in every engine."""
    return f"ROUND(CAST({expr} AS DOUBLE) + 3.7e-9, 6) + 0.0"


def columns(spec: str) -> str:
    """``d:`` date, ``i:`` whole number, ``r:`` rounded double, nothing: as it is."""
    out = []
    for item in spec.split():
        kind, _, name = item.rpartition(":")
        out.append(
            {
                "": f'"{name}"',
                "d": f'CAST(CAST("{name}" AS DATE) AS VARCHAR) AS "{name}"',
                "i": f'CAST("{name}" AS BIGINT) AS "{name}"',
                "r": f'{rounded(chr(34) + name + chr(34))} AS "{name}"',
            }[kind]
        )
    return ", ".join(out)


# shared relations, each may use the ones before it
CTES = {
    "ev": """SELECT event_id, event_type, value, CAST(user_id AS VARCHAR) AS rider_id, ts,
        ts - INTERVAL 8218 DAY AS moved, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events""",
    "ol": "SELECT *, CAST(o_custkey AS VARCHAR) AS rider_id, CAST(o_orderdate AS DATE) AS oday FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "home": """SELECT CAST(c_custkey AS VARCHAR) AS rider_id, c_custkey, c_mktsegment, c_acctbal, n_name, r_name FROM customer
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "done": """SELECT rider_id, oday, CAST(l_shipdate AS DATE) AS drop_day FROM ol
        WHERE l_linenumber = 1 AND l_linestatus = 'F' AND l_quantity >= 2""",
    "elig": f"SELECT DISTINCT rider_id FROM done WHERE oday BETWEEN {START} AND {AS_OF}",
    "slot": """SELECT CAST(o_custkey AS VARCHAR) AS rider_id, CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders
        WHERE o_orderstatus IN ('F', 'O')""",
    "lastslot": f"SELECT rider_id, MAX(day) AS last_day FROM slot WHERE day BETWEEN {START} AND {AS_OF} GROUP BY rider_id",
    "attrs": """SELECT CAST(o_custkey AS VARCHAR) AS rider_id, MIN(CAST(o_orderdate AS DATE)) AS first_order_date,
        MAX(CAST(o_orderdate AS DATE)) AS last_order_date FROM orders GROUP BY 1""",
}


def with_(*names: str, **extra: str) -> str:
    """WITH clause of the named shared relations in their own order, then the extra ones."""
    parts = [f"{n} AS ({q})" for n, q in CTES.items() if n in names]
    parts += [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ",\n".join(parts)


def add(name: str, with_clause: str, spec: str, source: str) -> None:
    _SQL[name] = f"{with_clause}\nSELECT {columns(spec)} FROM {source}"


def start_of(unit: str, expr: str) -> str:
    return f"CAST(date_trunc('{unit}', {expr}) AS DATE)"


def days(later: str, earlier: str) -> str:
    return f"date_diff('day', {earlier}, {later})"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


# ---- activity ------------------------------------------------------------------------------------

BASE = ("ol", "done", "elig", "slot", "lastslot", "attrs")


def snapshot_cte(unit: str, newbie: int) -> str:
    return f"""SELECT f.rider_id,
        CASE WHEN {days(AS_OF, 'f.first_day')} < {newbie} THEN 'newbie' ELSE 'active' END AS segment,
        {start_of(unit, 'f.first_day')} AS start_week_of_tenure,
        {days(AS_OF, 'f.first_day')} AS tenure_days,
        CASE WHEN l.last_day IS NULL THEN {start_of(unit, 'f.first_day')}
             WHEN {days(AS_OF, 'l.last_day')} >= 180 THEN {start_of(unit, 'l.last_day')} END AS week_of_churn,
        CASE WHEN l.last_day IS NULL THEN {days(AS_OF, 'f.first_day')} ELSE {days(AS_OF, 'l.last_day')} END AS days_since_last_slot,
        CASE WHEN l.last_day IS NULL OR {days(AS_OF, 'l.last_day')} >= 180 THEN 1 ELSE 0 END AS is_churned
        FROM (SELECT rider_id, MIN(drop_day) AS first_day FROM done GROUP BY 1) f
        JOIN elig USING (rider_id) LEFT JOIN lastslot l ON l.rider_id = f.rider_id"""


def anchor_cte(unit: str, newbie: int) -> str:
    return f"""SELECT rider_id, first_order_date, last_order_date,
        CASE WHEN {days(AS_OF, 'first_order_date')} < {newbie} THEN 'newbie' ELSE 'active' END AS segment,
        week_of_churn, COALESCE(week_of_churn, {start_of(unit, AS_OF)}) AS anchor_week, churned
        FROM (SELECT e.rider_id, a.first_order_date, a.last_order_date,
            (l.last_day IS NULL OR {days(AS_OF, 'l.last_day')} >= 180) AS churned,
            CASE WHEN l.last_day IS NULL THEN {start_of(unit, 'a.first_order_date')}
                 WHEN {days(AS_OF, 'l.last_day')} >= 180 THEN {start_of(unit, 'l.last_day')} END AS week_of_churn
            FROM elig e JOIN attrs a USING (rider_id) LEFT JOIN lastslot l ON l.rider_id = e.rider_id)"""


add(
    "activity_snapshot",
    with_(*BASE, s=snapshot_cte("week", 30)),
    "rider_id segment d:start_week_of_tenure i:tenure_days d:week_of_churn i:days_since_last_slot i:is_churned i:churn",
    "(SELECT *, is_churned AS churn FROM s)",
)
add(
    "churned_count",
    with_(*BASE, s=snapshot_cte("week", 30)),
    "i:churned_riders_in_timeframe",
    "(SELECT COUNT(DISTINCT rider_id) AS churned_riders_in_timeframe FROM s WHERE is_churned = 1)",
)
# riders are dealt over three countries by their number
IN_ONE = "CAST(rider_id AS BIGINT) % 3 = 1"
add(
    "snapshot_country",
    with_(*BASE, s=snapshot_cte("week", 30)),
    "rider_id segment d:start_week_of_tenure i:tenure_days d:week_of_churn i:days_since_last_slot i:is_churned i:churn",
    f"(SELECT *, is_churned AS churn FROM s WHERE {IN_ONE})",
)
add("eligible_riders", with_("ol", "done", "elig"), "rider_id", "elig")
add(
    "churned_riders",
    with_(*BASE, a=anchor_cte("week", 30)),
    "rider_id segment d:week_of_churn",
    "(SELECT * FROM a WHERE churned)",
)

RELATIVE = """SELECT a.rider_id, a.segment, a.week_of_churn, r.week_offset,
    CAST(a.anchor_week - to_months(3 * CAST(r.week_offset AS INTEGER)) AS DATE) AS feature_week
    FROM a CROSS JOIN range(8) r(week_offset)"""
add(
    "relative_periods",
    with_(*BASE, a=anchor_cte("quarter", 2250), r=RELATIVE),
    "rider_id segment d:week_of_churn i:week_offset d:feature_week",
    "r",
)


def gaps_cte(unit: str) -> str:
    return f"""SELECT rider_id, {start_of(unit, 'day')} AS week, AVG(date_diff('day', prev, day)) AS slot_gap_mean_days,
        MAX(date_diff('day', prev, day)) AS slot_gap_max_days
        FROM (SELECT rider_id, day, LAG(day) OVER (PARTITION BY rider_id ORDER BY day) AS prev FROM slot
              WHERE rider_id IN (SELECT rider_id FROM elig))
        WHERE prev IS NOT NULL GROUP BY 1, 2"""


add(
    "booking_gaps",
    with_(*BASE, g=gaps_cte("week")),
    "rider_id d:week r:slot_gap_mean_days i:slot_gap_max_days",
    "g",
)
add(
    "label_by_segment_threshold",
    with_(
        "slot",
        "attrs",
        b=f"""SELECT a.rider_id, CASE WHEN {days(AS_OF, 'first_order_date')} < 2250 THEN 'newbie' ELSE 'active' END AS segment,
            {days(AS_OF, 'm.d')} AS days_since_last_booking
            FROM attrs a LEFT JOIN (SELECT rider_id, MAX(day) AS d FROM slot GROUP BY 1) m ON m.rider_id = a.rider_id""",
    ),
    "rider_id i:is_churned i:days_since_last_booking segment",
    """(SELECT *, CASE WHEN days_since_last_booking IS NULL OR days_since_last_booking >=
        CASE WHEN segment = 'newbie' THEN 90 ELSE 180 END THEN 1 ELSE 0 END AS is_churned FROM b)""",
)
add(
    "booking_patterns",
    with_(
        "slot",
        g=f"""SELECT rider_id, day, {days(AS_OF, 'day')} AS age,
            date_diff('day', LAG(day) OVER (PARTITION BY rider_id ORDER BY day), day) AS gap FROM slot""",
        s="""SELECT rider_id, COUNT(*) FILTER (age < 7) AS slots_last_7d, COUNT(*) FILTER (age < 14) AS slots_last_14d,
            COUNT(*) FILTER (age < 28) AS slots_last_28d, COUNT(*) FILTER (age >= 7 AND age < 14) AS p7,
            COUNT(*) FILTER (age >= 14 AND age < 28) AS p14, MIN(age) AS days_since_last_booking,
            stddev_samp(gap) AS booking_regularity FROM g GROUP BY 1""",
    ),
    "rider_id i:slots_last_7d i:slots_last_14d i:slots_last_28d r:slots_trend_7d r:slots_trend_14d i:days_since_last_booking r:booking_regularity",
    f"(SELECT *, {ratio('slots_last_7d - p7', 'p7')} AS slots_trend_7d, {ratio('slots_last_14d - p14', 'p14')} AS slots_trend_14d FROM s)",
)

# ---- sources -------------------------------------------------------------------------------------

add(
    "filtered_scan",
    "",
    "i:o_orderkey i:o_custkey r:o_totalprice d:o_orderdate",
    "(SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2001-08-01' AND o_custkey IS NOT NULL)",
)
add(
    "flattened_deliveries",
    with_(
        "ol",
        f="""SELECT rider_id, l_linestatus, l_linenumber = 1 AS is_primary FROM ol WHERE l_quantity >= 2
            UNION ALL SELECT rider_id, l_linestatus, FALSE FROM ol WHERE l_quantity > 40""",
    ),
    "delivery_status is_primary i:n i:riders",
    """(SELECT CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'cancelled' END AS delivery_status, is_primary,
        COUNT(*) AS n, COUNT(DISTINCT rider_id) AS riders FROM f GROUP BY 1, 2)""",
)
add(
    "outer_flatten",
    with_("ev"),
    "rider_id i:records i:violations",
    """(SELECT rider_id, COUNT(*) AS records, COUNT(*) FILTER (k % 11 <> 0) AS violations FROM ev
        WHERE event_type = 'error' GROUP BY 1)""",
)
add(
    "city_extract",
    with_("home"),
    "rider_id city_code d:created_date shift_state",
    f"""(SELECT h.rider_id, n_name AS city_code, o_orderdate AS created_date,
        CASE o_orderstatus WHEN 'F' THEN 'EVALUATED' WHEN 'O' THEN 'PUBLISHED' ELSE 'OTHER' END AS shift_state
        FROM orders JOIN home h ON o_custkey = c_custkey
        WHERE n_name = 'NATION_3' AND CAST(o_orderdate AS DATE) >= {AS_OF} - 365)""",
)
add(
    "courier_base_extract",
    with_(
        "home",
        b="""SELECT rider_id AS courier_id, n_name AS city_code, MIN(CAST(o_orderdate AS DATE)) AS hire_date, COUNT(*) AS total_orders,
            c_mktsegment AS vehicle_type, 'channel_' || CAST(c_custkey % 3 AS VARCHAR) AS onboarding_channel
            FROM home JOIN orders ON c_custkey = o_custkey GROUP BY ALL""",
    ),
    "courier_id city_code d:hire_date i:total_orders vehicle_type onboarding_channel i:tenure_days",
    f"""(SELECT *, {days(AS_OF, 'hire_date')} AS tenure_days FROM b
        WHERE city_code = 'NATION_3' AND {days(AS_OF, 'hire_date')} <= 2400)""",
)
add(
    "parameter_query",
    "",
    "o_orderpriority i:n r:total",
    """(SELECT o_orderpriority, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders
        WHERE o_orderdate >= DATE '1997-01-01' AND o_orderstatus <> 'P' GROUP BY 1)""",
)
add(
    "first_rows",
    "",
    "i:o_orderkey r:o_totalprice",
    "(SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1000)",
)
add(
    "coerced_values",
    "",
    "i:c_custkey r:number d:day r:filled r:clipped",
    """(SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN TRY_CAST(SUBSTRING(c_name, 10, 20) AS DOUBLE) END AS number,
        CASE WHEN c_custkey % 3 = 0 THEN DATE '1999-02-03' END AS day, COALESCE(TRY_CAST(c_name AS DOUBLE), 7) AS filled,
        GREATEST(c_acctbal, 0) AS clipped FROM customer)""",
)

_METRICS_OF_PART = ("Earnings per hour", "slot_gap", "contacts", "distance", "no_shows", "bw_orders", "hours", "batch", "Unknown")
_COSTS_OF_PART = ("Low", "medium", "High", "Unknown")


def _any_of(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def _pick(index: str, values) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_OWNER = "CASE " + " ".join(f"WHEN {_any_of('txt', p)} THEN '{o}'" for o, p in OWNER_KEYWORDS.items()) + " ELSE 'City Ops' END"
PLAYBOOK = f"""SELECT *, {_OWNER} AS owner FROM (SELECT *, lower(metric || ' ' || action) AS txt FROM (
    SELECT p_partkey AS row_no, p_type AS impact, {_pick('p_partkey % 9', _METRICS_OF_PART)} AS metric, p_brand AS reason,
    trim(p_name || ' ' || p_brand) AS action, {_pick('p_size % 4', _COSTS_OF_PART)} AS estimated_cost
    FROM part WHERE p_size % 13 <> 0))"""
add("playbook_rows", with_(b=PLAYBOOK), "i:row_no impact metric reason action estimated_cost owner", "b")

# ---- weekly aggregates ---------------------------------------------------------------------------


def shifts_cte(unit: str, per_hour: str = "3600.0", only: str = "WHERE rider_id IN (SELECT rider_id FROM elig)") -> str:
    return f"""SELECT rider_id, {start_of(unit, 'oday')} AS week, MAX(n_name) AS city_name, MAX(c_mktsegment) AS vehicle_name,
        MAX(l_linenumber) AS batch_number, COUNT(*) FILTER (l_returnflag = 'R') AS no_shows,
        COUNT(*) FILTER (l_returnflag = 'A') AS shifts_done, COUNT(*) AS all_shifts,
        SUM(l_quantity * 360) / {per_hour} AS hours_worked,
        CAST(COUNT(*) FILTER (l_returnflag = 'R') AS DOUBLE) / COUNT(*) AS perc_no_show
        FROM ol JOIN home USING (rider_id) {only} GROUP BY 1, 2"""


PAID = """SELECT rider_id, oday, l_orderkey AS order_id, l_linenumber, l_partkey, l_suppkey, o_orderpriority AS zone_name, n_name AS city_code,
    l_linestatus = 'F' AS completed, o_totalprice / 1000 AS pay,
    CASE o_orderpriority WHEN '1-URGENT' THEN o_totalprice / 1000 * 0.06::DOUBLE WHEN '5-LOW' THEN NULL ELSE 0.0 END AS rain,
    CASE o_orderpriority WHEN '2-HIGH' THEN o_totalprice / 1000 * 0.02::DOUBLE ELSE 0.0 END AS snow,
    CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL WHEN '2-HIGH' THEN FALSE ELSE TRUE END AS flag_a,
    o_orderpriority <> '3-MEDIUM' AS flag_b,
    CASE WHEN o_orderstatus = 'F' THEN 'DeliveredStatus' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'cancelled'
         WHEN o_orderstatus = 'O' THEN 'delivered' END AS final_status,
    CASE WHEN l_returnflag <> 'N' THEN l_quantity * 100 END AS pickup, l_extendedprice / 10 AS dropoff,
    l_returnflag, l_quantity, l_discount, l_tax
    FROM ol JOIN home USING (rider_id)"""
_COUNTED = "CASE WHEN (final_status <> 'cancelled' AND flag_a) OR (final_status = 'DeliveredStatus' AND flag_b) THEN 1 END"


def delivery_columns(vendor_rows: str) -> str:
    return f"""SUM({_COUNTED}) AS total_orders_cpo,
        COUNT(DISTINCT CASE WHEN rain + snow > 0 AND completed THEN order_id END) AS total_bw_orders,
        SUM(pay) AS total_earnings, {ratio('SUM(pay)', f'SUM({_COUNTED})')} AS cpo_local_currency,
        {ratio('SUM(pay - rain - snow)', f'SUM({_COUNTED})')} AS net_cpo_lc,
        CAST(COUNT(*) FILTER (completed AND l_linenumber >= 2) AS DOUBLE) / COUNT(*) AS perc_stacking,
        AVG(pickup) / 1000 AS avg_sp_distance_google, AVG(dropoff) / 1000 AS avg_pd_distance_google,
        AVG(pickup + dropoff) / 1000 AS avg_total_distance_google,
        AVG(l_discount * 100) FILTER (l_returnflag <> 'A' AND l_discount * 100 > 0) AS at_customer_time_in_minutes,
        {ratio("SUM(l_quantity / 3) FILTER (l_tax > 0 AND l_discount <> 0)", vendor_rows)} AS at_vendor_time_in_minutes,
        AVG(l_quantity) AS cdt, CAST(COUNT(*) FILTER (l_returnflag = 'R') AS DOUBLE) / COUNT(*) AS perc_reas"""


def delivery_cte(unit: str, only: str = "WHERE rider_id IN (SELECT rider_id FROM elig)") -> str:
    return f"""SELECT rider_id, {start_of(unit, 'oday')} AS week, MAX(city_code) AS city_code, MAX(zone_name) AS zone_name,
        {delivery_columns('COUNT(*) FILTER (l_tax > 0)')} FROM paid {only} GROUP BY 1, 2"""


SHIFT_SPEC = "city_name vehicle_name i:batch_number i:no_shows i:shifts_done i:all_shifts r:hours_worked r:perc_no_show"
MEASURES = (
    "i:total_orders_cpo i:total_bw_orders r:total_earnings r:cpo_local_currency r:net_cpo_lc r:perc_stacking "
    "r:avg_sp_distance_google r:avg_pd_distance_google r:avg_total_distance_google r:at_customer_time_in_minutes "
    "r:at_vendor_time_in_minutes r:cdt r:perc_reas"
)
ALL_BASE = ("ev", "home", *BASE)
add("weekly_shift_kpis", with_(*ALL_BASE, k=shifts_cte("week")), f"rider_id d:week {SHIFT_SPEC}", "k")
add(
    "weekly_delivery_economics",
    with_(*ALL_BASE, paid=PAID, d=delivery_cte("week")),
    f"rider_id d:week city_code zone_name {MEASURES}",
    "d",
)
add(
    "weekly_delivery_deduped",
    with_(
        *ALL_BASE,
        paid=PAID,
        o=f"""SELECT rider_id, {start_of('quarter', 'oday')} AS week, order_id, ANY_VALUE({_COUNTED}) AS counted, ANY_VALUE(pay) AS pay,
            ANY_VALUE(rain + snow > 0) AS bw, BOOL_OR(completed) AS any_completed,
            arg_min(completed, concat_ws('-', order_id, l_linenumber, l_partkey, l_suppkey)) AS first_completed FROM paid GROUP BY 1, 2, 3""",
    ),
    "rider_id d:week i:total_orders_cpo r:total_earnings i:total_bw_orders",
    """(SELECT rider_id, week, SUM(counted) AS total_orders_cpo, SUM(pay) AS total_earnings,
        COUNT(*) FILTER (bw AND first_completed) AS total_bw_orders FROM o GROUP BY 1, 2)""",
)
add(
    "weekly_kpi_variant",
    with_(
        *ALL_BASE,
        paid=PAID,
        k=shifts_cte("week", "60.0", ""),
        m=f"""SELECT 'ALL' AS country_code, city_code, zone_name, rider_id, {start_of('week', 'oday')} AS week,
            {delivery_columns('COUNT(*) FILTER (l_tax > 0 AND l_discount <> 0)')} FROM paid GROUP BY ALL""",
    ),
    f"country_code city_code zone_name rider_id d:week {MEASURES} r:earning_per_hour r:no_shows r:shifts_done r:all_shifts r:hours_worked r:perc_no_show",
    f"""(SELECT m.*, {ratio('total_earnings', 'hours_worked')} AS earning_per_hour, no_shows, shifts_done, all_shifts, hours_worked, perc_no_show
        FROM m LEFT JOIN k USING (rider_id, week))""",
)


def tickets_cte(unit: str, only: str = "AND rider_id IN (SELECT rider_id FROM elig)") -> str:
    return f"""SELECT rider_id, {start_of(unit, 'moved')} AS week, COUNT(*) AS contacts_total_tickets, AVG(value) AS avg_sat_score
        FROM ev WHERE k % 10 <> 0 {only} AND CAST(moved AS DATE) <= {AS_OF} GROUP BY 1, 2"""


add("weekly_tickets", with_(*ALL_BASE, t=tickets_cte("week")), "rider_id d:week i:contacts_total_tickets r:avg_sat_score", "t")

_LABEL = "CASE " + " ".join(f"WHEN k = {i} THEN '{v}'" for i, v in enumerate(REASON_LABELS.values()))
_LABEL += f" WHEN k < 80 AND k >= {len(REASON_LABELS)} THEN 'K' || CAST(k % 6 AS VARCHAR) ELSE 'unknown' END"
REASONS = f"""SELECT rider_id, {start_of('week', 'moved')} AS week, {_LABEL} AS contact_reason_code, COUNT(*) AS ticket_count
    FROM ev WHERE event_type <> 'view' GROUP BY 1, 2, 3"""
add("ticket_reasons", with_("ev", t=REASONS), "rider_id d:week contact_reason_code i:ticket_count", "t")


add(
    "weekly_tickets_country",
    with_("ev", t=tickets_cte("week", f"AND {IN_ONE}")),
    "rider_id d:week i:contacts_total_tickets r:avg_sat_score",
    "t",
)
add("ticket_reasons_country", with_("ev", t=REASONS), "rider_id d:week contact_reason_code i:ticket_count", f"(SELECT * FROM t WHERE {IN_ONE})")


def violations_cte(unit: str) -> str:
    return f"""SELECT rider_id, week, COUNT(DISTINCT event_id) AS compliance_total_violations,
        COUNT(DISTINCT t) AS compliance_distinct_violation_types FROM (
            SELECT rider_id, {start_of(unit, 'moved')} AS week, event_id, 'Type ' || CAST(k % 4 AS VARCHAR) AS t FROM ev
            WHERE event_type = 'error' AND k % 11 <> 0 AND k % 3 > 0
            UNION ALL SELECT rider_id, {start_of(unit, 'moved')}, event_id, 'GPS-spoof' FROM ev
            WHERE event_type = 'error' AND k % 11 <> 0 AND k % 3 > 0 AND k % 2 = 1)
        WHERE rider_id IN (SELECT rider_id FROM elig) GROUP BY 1, 2"""


add(
    "weekly_violations",
    with_(*ALL_BASE, v=violations_cte("week")),
    "rider_id d:week i:compliance_total_violations i:compliance_distinct_violation_types",
    "v",
)
TYPE_ACTION = f"""SELECT rider_id, {start_of('week', 'moved')} AS week, violation_type, action_type, COUNT(DISTINCT event_id) AS violations_count
    FROM (SELECT *, CASE r WHEN 0 THEN 'Type ' || CAST(k % 4 AS VARCHAR) ELSE 'GPS-spoof' END AS violation_type,
                 CASE a WHEN 0 THEN 'warning' ELSE 'Temp block' END AS action_type
          FROM ev, range(2) x(r), range(2) y(a)
          WHERE event_type = 'error' AND k % 11 <> 0 AND r <= k % 2 AND a < k % 3) GROUP BY 1, 2, 3, 4"""
add(
    "violations_by_type_action",
    with_("ev", v=TYPE_ACTION),
    "rider_id d:week violation_type action_type i:violations_count",
    "v",
)
BENCHMARK = f"""SELECT city_code, week, quantile_disc(rate, 0.5) AS city_median_earnings_per_hour, AVG(total_earnings) AS city_avg_total_earnings
    FROM (SELECT d.city_code, d.week, d.total_earnings, {ratio('d.total_earnings', 'k.hours_worked')} AS rate
          FROM d LEFT JOIN k USING (rider_id, week)) GROUP BY 1, 2"""
add(
    "city_benchmark",
    with_(*ALL_BASE, paid=PAID, d=delivery_cte("quarter"), k=shifts_cte("quarter"), b=BENCHMARK),
    "city_code d:week r:city_median_earnings_per_hour r:city_avg_total_earnings",
    "b",
)
APPLICATIONS = """SELECT rider_id, MIN(CAST(moved AS DATE)) AS registration_date,
    arg_max_null(CASE WHEN k % 7 <> 0 THEN 'source_' || CAST(k % 5 AS VARCHAR) END, moved) AS utm_source
    FROM ev WHERE event_type = 'signup' GROUP BY 1"""
add("acquisition_source", with_("ev", s=APPLICATIONS), "rider_id d:registration_date utm_source", "s")

add(
    "acquisition_source_country",
    with_("ev", s=APPLICATIONS),
    "rider_id d:registration_date utm_source",
    f"(SELECT * FROM s WHERE {IN_ONE})",
)

_HOLIDAY_DAYS = ", ".join(f"'{d}'" for d in FIXED_HOLIDAYS)


def holidays_cte(unit: str) -> str:
    return f"""SELECT {start_of(unit, 'd')} AS week, COUNT(*) AS holiday_days_in_week
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) WHERE strftime(d, '%m-%d') IN ({_HOLIDAY_DAYS}) GROUP BY 1"""


add("holiday_weeks", with_(h=holidays_cte("week")), "d:week i:holiday_days_in_week", "h")

# ---- feature tables ------------------------------------------------------------------------------

EARLY = f"""SELECT f.rider_id, f.first_order_date, s.registration_date,
    {days('f.first_order_date', 's.registration_date')} AS days_registration_to_first_order,
    o.orders_first_7d, o.orders_first_30d, COALESCE(c.n, 0) AS compliance_events_first_30d,
    d.total_earnings AS first_week_earnings, b.city_avg_total_earnings AS city_avg_earnings_first_week,
    {ratio('d.total_earnings', 'b.city_avg_total_earnings')} AS first_week_earnings_vs_city_avg_ratio
    FROM (SELECT *, {start_of('quarter', 'first_order_date')} AS week FROM a WHERE segment = 'newbie') f
    LEFT JOIN s ON s.rider_id = f.rider_id
    LEFT JOIN (SELECT x.rider_id, COUNT(*) FILTER (date_diff('day', x.first_order_date, z.drop_day) BETWEEN 0 AND 6) AS orders_first_7d,
        COUNT(*) FILTER (date_diff('day', x.first_order_date, z.drop_day) BETWEEN 0 AND 29) AS orders_first_30d
        FROM a x JOIN done z ON z.rider_id = x.rider_id WHERE z.oday <= {AS_OF} GROUP BY 1) o ON o.rider_id = f.rider_id
    LEFT JOIN (SELECT x.rider_id, COUNT(DISTINCT event_id) AS n FROM a x JOIN ev ON ev.rider_id = x.rider_id
        WHERE event_type = 'error' AND k % 11 <> 0 AND CAST(moved AS DATE) BETWEEN x.first_order_date AND x.first_order_date + 29
        GROUP BY 1) c ON c.rider_id = f.rider_id
    LEFT JOIN d ON d.rider_id = f.rider_id AND d.week = f.week
    LEFT JOIN b ON b.city_code = d.city_code AND b.week = d.week"""
COMBINED = f"""SELECT r.rider_id, r.segment, r.week_of_churn, r.week_offset, r.feature_week,
    COALESCE(d.city_code, k.city_name) AS city_code, d.zone_name, k.vehicle_name, k.batch_number,
    d.total_orders_cpo, d.total_bw_orders, d.total_earnings, d.cpo_local_currency, d.net_cpo_lc, d.perc_stacking,
    d.avg_sp_distance_google, d.avg_pd_distance_google, d.avg_total_distance_google, d.at_customer_time_in_minutes,
    d.at_vendor_time_in_minutes, d.cdt, d.perc_reas, k.no_shows, k.shifts_done, k.all_shifts, k.hours_worked, k.perc_no_show,
    t.contacts_total_tickets, t.avg_sat_score, v.compliance_total_violations, v.compliance_distinct_violation_types,
    {ratio('d.total_earnings', 'k.hours_worked')} AS earnings_per_hour, b.city_median_earnings_per_hour,
    {ratio('d.total_earnings', 'k.hours_worked')} - b.city_median_earnings_per_hour AS earnings_vs_city_median_abs,
    {ratio('d.total_earnings', 'k.hours_worked')} / NULLIF(b.city_median_earnings_per_hour, 0) AS earnings_vs_city_median_ratio,
    g.slot_gap_mean_days, g.slot_gap_max_days, COALESCE(h.holiday_days_in_week, 0) AS holiday_days_in_week,
    CASE WHEN month(r.feature_week) IN (12, 1, 2) THEN 'winter' WHEN month(r.feature_week) IN (3, 4, 5) THEN 'spring'
         WHEN month(r.feature_week) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season_name
    FROM r LEFT JOIN d ON d.rider_id = r.rider_id AND d.week = r.feature_week
    LEFT JOIN k ON k.rider_id = r.rider_id AND k.week = r.feature_week
    LEFT JOIN t ON t.rider_id = r.rider_id AND t.week = r.feature_week
    LEFT JOIN v ON v.rider_id = r.rider_id AND v.week = r.feature_week
    LEFT JOIN b ON b.city_code = d.city_code AND b.week = r.feature_week
    LEFT JOIN g ON g.rider_id = r.rider_id AND g.week = r.feature_week
    LEFT JOIN h ON h.week = r.feature_week"""


def feature_ctes(periods: int = 8) -> str:
    return with_(
        *ALL_BASE,
        paid=PAID,
        a=anchor_cte("quarter", 2250),
        r=RELATIVE.replace("range(8)", f"range({periods})"),
        d=delivery_cte("quarter"),
        k=shifts_cte("quarter"),
        t=tickets_cte("quarter"),
        v=violations_cte("quarter"),
        g=gaps_cte("quarter"),
        h=holidays_cte("quarter"),
        b=BENCHMARK,
        s=APPLICATIONS,
        e=EARLY,
        w=COMBINED,
    )


WHOLE = {
    "batch_number", "total_orders_cpo", "total_bw_orders", "no_shows", "shifts_done", "all_shifts", "contacts_total_tickets",
    "compliance_total_violations", "compliance_distinct_violation_types", "slot_gap_max_days", "holiday_days_in_week",
}


def kind(metric: str) -> str:
    return f"i:{metric}" if metric in WHOLE else f"r:{metric}"


add(
    "early_life",
    feature_ctes(),
    "rider_id d:first_order_date d:registration_date i:days_registration_to_first_order i:orders_first_7d i:orders_first_30d "
    "i:compliance_events_first_30d r:first_week_earnings r:city_avg_earnings_first_week r:first_week_earnings_vs_city_avg_ratio",
    "e",
)
add(
    "combine_weekly",
    feature_ctes(),
    "rider_id segment d:week_of_churn i:week_offset d:feature_week city_code zone_name vehicle_name season_name r:avg_total_distance_google "
    "r:perc_no_show " + " ".join(kind(m) for m in WEEKLY_METRICS),
    "w",
)


def cell(m: str, k: int) -> str:
    return f"MAX({m}) FILTER (week_offset = {k})"


def span(m: str, lo: int, hi: int) -> str:
    return f"COALESCE(SUM({m}) FILTER (week_offset BETWEEN {lo} AND {hi}), 0)"


def pivot_sql(metrics, periods: int = 8) -> str:
    cells = [f"{cell(m, k)} AS {m}_W{k}" for m in metrics for k in range(periods)]
    stable = [
        f"COALESCE(MAX({c}) FILTER (week_offset = 0), MAX({c})) AS {c}" for c in ("city_code", "zone_name", "vehicle_name")
    ]
    return f"""SELECT rider_id, 'ALL' AS country_code, {', '.join(stable)}, MAX(segment) AS segment, MAX(week_of_churn) AS week_of_churn,
        MAX(feature_week) AS anchor_week, {', '.join(cells)} FROM w GROUP BY rider_id"""


DELTAS = [
    (f"{m}_delta_W0_W{k}", f"{cell(m, 0)} - {cell(m, k)}", m in WHOLE) for m in DELTA_METRICS for k in (1, 7)
]
_DELTA_SQL = ", ".join(f"{q} AS {n}" for n, q, _ in DELTAS)
_KM = "COALESCE(SUM(avg_total_distance_google * total_orders_cpo), 0)"
RFM = f"""{span('total_orders_cpo', 0, 3)} AS f_orders_4w, {span('total_orders_cpo', 0, 7)} AS f_orders_8w,
    {span('total_earnings', 0, 3)} AS m_earnings_4w, {span('total_earnings', 0, 7)} AS m_earnings_8w,
    {ratio(span('total_earnings', 0, 3), span('total_earnings', 4, 7))} AS m_earnings_recent4w_vs_prev4w_ratio,
    {ratio(span('total_orders_cpo', 0, 3), span('total_orders_cpo', 4, 7))} AS f_orders_recent4w_vs_prev4w_ratio,
    {ratio(span('total_earnings', 0, 7), _KM)} AS earnings_per_km_8w"""
DELTA_SPEC = " ".join(("i:" if whole else "r:") + n for n, _, whole in DELTAS)
RFM_SPEC = (
    "i:r_recency_days_at_anchor i:f_orders_4w i:f_orders_8w r:m_earnings_4w r:m_earnings_8w "
    "r:m_earnings_recent4w_vs_prev4w_ratio r:f_orders_recent4w_vs_prev4w_ratio r:earnings_per_km_8w"
)
add("period_deltas", feature_ctes(), f"rider_id {DELTA_SPEC}", f"(SELECT rider_id, {_DELTA_SQL} FROM w GROUP BY rider_id)")
add(
    "rfm",
    feature_ctes(),
    f"rider_id {RFM_SPEC}",
    f"""(SELECT x.*, {days('x.anchor_week', 'attrs.last_order_date')} AS r_recency_days_at_anchor FROM
        (SELECT rider_id, MAX(feature_week) AS anchor_week, {RFM} FROM w GROUP BY rider_id) x JOIN attrs USING (rider_id))""",
)
EARLY_SPEC = (
    "i:days_registration_to_first_order i:orders_first_7d i:orders_first_30d i:compliance_events_first_30d "
    "r:first_week_earnings r:city_avg_earnings_first_week r:first_week_earnings_vs_city_avg_ratio"
)
add(
    "pivot_features",
    feature_ctes(),
    "rider_id country_code city_code zone_name vehicle_name segment d:first_order_date d:last_order_date d:week_of_churn d:anchor_week utm_source "
    + " ".join(kind(m).replace(m, f"{m}_W{k}") for m in WEEKLY_METRICS for k in range(8))
    + f" season_name_W0 {DELTA_SPEC} {RFM_SPEC} {EARLY_SPEC}",
    f"""(SELECT x.*, y.* EXCLUDE (rider_id), attrs.first_order_date, attrs.last_order_date, s.utm_source,
        {days('x.anchor_week', 'attrs.last_order_date')} AS r_recency_days_at_anchor,
        e.* EXCLUDE (rider_id, first_order_date, registration_date)
        FROM ({pivot_sql(WEEKLY_METRICS)}) x
        JOIN (SELECT rider_id, MAX(season_name) FILTER (week_offset = 0) AS season_name_W0, {_DELTA_SQL}, {RFM} FROM w GROUP BY rider_id) y
          ON y.rider_id = x.rider_id
        LEFT JOIN attrs ON attrs.rider_id = x.rider_id LEFT JOIN s ON s.rider_id = x.rider_id LEFT JOIN e ON e.rider_id = x.rider_id)""",
)
_OF_ONE = CTES["elig"] + f" AND {IN_ONE}"
_SQL["pivot_features_country"] = _SQL["pivot_features"].replace(f"elig AS ({CTES['elig']})", f"elig AS ({_OF_ONE})").replace("'ALL'", "'one'")

HISTORY_METRICS = ("total_orders_cpo", "total_earnings", "no_shows")
_AGE = "(date_diff('month', date_trunc('quarter', o_orderdate), DATE '2001-07-01') // 3)"
_HISTORY = ", ".join(
    [f"NULLIF(COUNT(*) FILTER ({_AGE} = {k}), 0) AS total_orders_cpo_W{k}" for k in range(8)]
    + [f"SUM(o_totalprice) FILTER ({_AGE} = {k}) AS total_earnings_W{k}" for k in range(8)]
    + [
        f"SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) FILTER ({_AGE} = {k}) AS no_shows_W{k}"
        for k in range(8)
    ]
)
HISTORY = f"""SELECT CAST(o_custkey AS VARCHAR) AS rider_id, {_HISTORY}, COUNT(*) FILTER (o_orderstatus = 'P') AS late_total
    FROM orders GROUP BY 1"""
HISTORY_SPEC = " ".join(kind(m).replace(m, f"{m}_W{k}") for m in HISTORY_METRICS for k in range(8)) + " i:late_total"


def per_order_sql(numerators=("total_earnings", "no_shows")) -> tuple[str, str]:
    names = [(m, k) for k in range(8) for m in numerators]
    sql = ", ".join(f"{ratio(f'{m}_W{k}', f'total_orders_cpo_W{k}')} AS {m}_per_order_W{k}" for m, k in names)
    return sql, " ".join(f"r:{m}_per_order_W{k}" for m, k in names)


def least_squares(f: str) -> str:
    """The slope over the known values of a family, oldest first, written out: many of them in one row are too slow as subqueries."""
    y = [f"{f}_W{7 - x}" for x in range(8)]
    n, sx, sxx = ("(" + " + ".join(f"(CASE WHEN {v} IS NULL THEN 0.0 ELSE {float(x**e)} END)" for x, v in enumerate(y)) + ")" for e in (0, 1, 2))
    sy, sxy = ("(" + " + ".join(f"COALESCE({float(x**e)} * CAST({v} AS DOUBLE), 0.0)" for x, v in enumerate(y)) + ")" for e in (0, 1))
    return f"CASE WHEN {n} >= 3 THEN ({sxy} - {sx} * {sy} / {n}) / ({sxx} - {sx} * {sx} / {n}) END"


def trend_sql(families, written_out: bool = False) -> tuple[str, str]:
    sql, spec = [], []
    for f in families:
        for k in range(7):
            a, b = f"CAST({f}_W{k} AS DOUBLE)", f"CAST({f}_W{k + 1} AS DOUBLE)"
            sql += [f"{a} - {b} AS {f}_wow_delta_W{k}_W{k + 1}", f"({a} - {b}) / NULLIF({b}, 0) AS {f}_wow_pct_change_W{k}_W{k + 1}"]
            spec += [f"r:{f}_wow_delta_W{k}_W{k + 1}", f"r:{f}_wow_pct_change_W{k}_W{k + 1}"]
        points = ", ".join(f"({x}.0, CAST({f}_W{7 - x} AS DOUBLE))" for x in range(8))
        slope = f"(SELECT CASE WHEN COUNT(y) >= 3 THEN regr_slope(y, x) END FROM (VALUES {points}) v(x, y))"
        sql.append(f"{least_squares(f) if written_out else slope} AS {f}_trend_slope_8w")
        spec.append(f"r:{f}_trend_slope_8w")
    return ", ".join(sql), " ".join(spec)


_PO_SQL, _PO_SPEC = per_order_sql()
add("per_order", with_(h=HISTORY), f"rider_id {HISTORY_SPEC} {_PO_SPEC}", f"(SELECT *, {_PO_SQL} FROM h)")
_TR_SQL, _TR_SPEC = trend_sql(HISTORY_METRICS)
add("wow_trends", with_(h=HISTORY), f"rider_id {HISTORY_SPEC} {_TR_SPEC}", f"(SELECT *, {_TR_SQL} FROM h)")
_CS_SQL, _CS_SPEC = trend_sql((*HISTORY_METRICS, "total_earnings_per_order", "no_shows_per_order"))
add(
    "labelled_cross_section",
    with_(*BASE, sn=snapshot_cte("quarter", 2250), h=HISTORY, m=f"SELECT *, {_PO_SQL} FROM h"),
    f"rider_id i:is_churned segment i:tenure_days {HISTORY_SPEC} {_PO_SPEC} {_CS_SPEC}",
    f"(SELECT sn.rider_id, sn.is_churned, sn.segment, sn.tenure_days, m.* EXCLUDE (rider_id), {_CS_SQL} FROM sn LEFT JOIN m ON m.rider_id = sn.rider_id)",
)

PANEL_FAMILIES = ("total_orders_cpo", "total_earnings", "no_shows", "hours_worked", "slot_gap_mean_days")


def panel_sql(families, horizon: int, max_offset: int, delay: int, depth: int) -> str:
    """The panel from the long table: each event joins the periods at its own offset plus lag."""
    lags = ", ".join(f"MAX(CAST({m} AS DOUBLE)) FILTER (w.week_offset = ev2.o + {k}) AS {m}_W{k}" for m in families for k in range(8))
    return f"""SELECT ev2.rider_id, ANY_VALUE(ev2.segment) AS segment, ANY_VALUE(ev2.tenure_days) AS tenure_days, ev2.event_week,
        ANY_VALUE(ev2.is_churned) AS is_churned, {lags}
        FROM (SELECT a.rider_id, a.segment, sn.tenure_days, x.o, CAST(a.anchor_week - to_months(3 * CAST(x.o AS INTEGER)) AS DATE) AS event_week,
                CASE WHEN date_diff('month', a.anchor_week - to_months(3 * CAST(x.o AS INTEGER)), a.week_of_churn) BETWEEN 1 AND {3 * horizon} THEN 1 ELSE 0 END AS is_churned,
                a.week_of_churn, (SELECT MAX(anchor_week) FROM a) AS newest
              FROM a CROSS JOIN range({max_offset + 1}) x(o) LEFT JOIN sn ON sn.rider_id = a.rider_id) ev2
        JOIN w ON w.rider_id = ev2.rider_id AND w.week_offset < {depth}
        WHERE (ev2.week_of_churn IS NULL OR ev2.event_week < ev2.week_of_churn)
          AND ev2.event_week <= CAST(ev2.newest - to_months({3 * (horizon + delay)}) AS DATE)
        GROUP BY ev2.rider_id, ev2.event_week"""


PANEL_WITH = feature_ctes() + f",\nsn AS ({snapshot_cte('quarter', 2250)}),\np AS ({panel_sql(PANEL_FAMILIES, 2, 6, 0, 8)})"
add(
    "forward_panel",
    PANEL_WITH,
    "rider_id segment r:tenure_days d:event_week i:is_churned " + " ".join(f"r:{m}_W{k}" for m in PANEL_FAMILIES for k in range(8)),
    "p",
)
_FULL = ("total_orders_cpo", "total_earnings")
add(
    "forward_panel_full_history",
    feature_ctes(11) + f",\nsn AS ({snapshot_cte('quarter', 2250)}),\np AS ({panel_sql(_FULL, 2, 3, 1, 11)})",
    "rider_id segment r:tenure_days d:event_week i:is_churned " + " ".join(f"r:{m}_W{k}" for m in _FULL for k in range(8)),
    f"(SELECT * REPLACE (tenure_days - {days(AS_OF, 'event_week')} AS tenure_days) FROM p)",
)
add(
    "time_split",
    PANEL_WITH + ",\nc AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', event_week), 0.8) AS cut FROM p)",
    "part how i:rows d:first_week d:last_week r:positive_rate",
    """(SELECT CASE WHEN date_diff('day', DATE '1970-01-01', event_week) < cut THEN 'train' ELSE 'test' END AS part, 'time' AS how,
        COUNT(*) AS rows, MIN(event_week) AS first_week, MAX(event_week) AS last_week, AVG(is_churned) AS positive_rate
        FROM p, c GROUP BY 1)""",
)

# all families with the derived columns
_ALL_PO, _ALL_PO_SPEC = per_order_sql(PER_ORDER_METRICS)
_ALL_TR, _ALL_TR_SPEC = trend_sql(WEEKLY_METRICS, True)
_BOTH_TR, _BOTH_TR_SPEC = trend_sql((*WEEKLY_METRICS, *(f"{m}_per_order" for m in PER_ORDER_METRICS)), True)
WEEKLY_SPEC = " ".join(kind(m).replace(m, f"{m}_W{k}") for m in WEEKLY_METRICS for k in range(8))
STABLE_SPEC = "rider_id country_code city_code zone_name vehicle_name segment d:week_of_churn d:anchor_week"
ALL_WITH = feature_ctes() + f",\nx AS ({pivot_sql(WEEKLY_METRICS)})"
add("per_order_all", ALL_WITH, f"{STABLE_SPEC} {WEEKLY_SPEC} {_ALL_PO_SPEC}", f"(SELECT *, {_ALL_PO} FROM x)")
add("wow_trends_all", ALL_WITH, f"{STABLE_SPEC} {WEEKLY_SPEC} {_ALL_TR_SPEC}", f"(SELECT *, {_ALL_TR} FROM x)")
_KEPT = "country_code city_code zone_name vehicle_name segment_feat d:anchor_week"
add(
    "labelled_cross_section_all",
    ALL_WITH + f",\nsn AS ({snapshot_cte('quarter', 2250)}),\nxo AS (SELECT *, {_ALL_PO} FROM x)",
    f"rider_id i:is_churned segment i:tenure_days {_KEPT} {WEEKLY_SPEC} {_ALL_PO_SPEC} {_BOTH_TR_SPEC}",
    f"""(SELECT sn.rider_id, sn.is_churned, sn.segment, sn.tenure_days, xo.segment AS segment_feat, xo.* EXCLUDE (rider_id, segment), {_BOTH_TR}
        FROM sn LEFT JOIN xo ON xo.rider_id = sn.rider_id)""",
)


def panel_all(max_offset: int, delay: int, depth: int) -> str:
    """The panel of all families, then its ratios."""
    snapshot = f",\nsn AS ({snapshot_cte('quarter', 2250)})"
    return f"{feature_ctes(depth)}{snapshot},\np AS ({panel_sql(WEEKLY_METRICS, 2, max_offset, delay, depth)}),\nq AS (SELECT *, {_ALL_PO} FROM p)"


PANEL_ALL_SPEC = (
    "rider_id segment r:tenure_days d:event_week i:is_churned "
    + " ".join(f"r:{m}_W{k}" for m in WEEKLY_METRICS for k in range(8))
    + f" {_ALL_PO_SPEC} {_BOTH_TR_SPEC}"
)
add("forward_panel_all", panel_all(6, 0, 8), PANEL_ALL_SPEC, f"(SELECT *, {_BOTH_TR} FROM q)")
add(
    "forward_panel_full_history_all",
    panel_all(6, 1, 14),
    PANEL_ALL_SPEC,
    f"(SELECT q.* REPLACE (tenure_days - {days(AS_OF, 'event_week')} AS tenure_days), {_BOTH_TR} FROM q)",
)

# folds of the rolling backtest: every period with both classes before it
_FOLDS = """,
z AS (SELECT event_week AS t, COUNT(*) AS rows, SUM(is_churned) AS pos FROM p GROUP BY 1),
f AS (SELECT z.t, z.rows AS test_rows, z.pos AS test_pos, MIN(b.t) AS train_start_week, MAX(b.t) AS train_end_week,
  SUM(b.rows) AS train_rows, SUM(b.pos) AS train_pos FROM z JOIN z b ON b.t < z.t GROUP BY 1, 2, 3
  HAVING SUM(b.pos) > 0 AND SUM(b.pos) < SUM(b.rows))"""
_PANEL_ALL = panel_all(6, 0, 8)
add(
    "backtest_folds",
    _PANEL_ALL + _FOLDS,
    "d:test_week d:train_start_week d:train_end_week i:train_rows i:test_rows r:positive_rate_train r:positive_rate_test",
    "(SELECT t AS test_week, *, train_pos / train_rows::DOUBLE AS positive_rate_train, test_pos / test_rows::DOUBLE AS positive_rate_test FROM f)",
)
_LAGS = ", ".join(f"CAST({m}_W{k} AS DOUBLE) AS {m}_W{k}" for m in WEEKLY_METRICS for k in range(8))
add(
    "fold_fillings",
    _PANEL_ALL
    + _FOLDS
    + f""",
pv AS (SELECT event_week, {_LAGS} FROM p),
c AS (SELECT * FROM pv UNPIVOT INCLUDE NULLS (v FOR feature IN (COLUMNS(* EXCLUDE (event_week))))),
m AS (SELECT f.t, feature, quantile_cont(v, 0.5) AS median FROM f JOIN c ON c.event_week < f.t GROUP BY 1, 2)""",
    "d:test_week feature r:median r:mean r:deviation",
    """(SELECT m.t AS test_week, m.feature, m.median, AVG(COALESCE(v, m.median)) AS mean, STDDEV_POP(COALESCE(v, m.median)) AS deviation
        FROM m JOIN c ON c.feature = m.feature AND c.event_week < m.t WHERE m.median IS NOT NULL GROUP BY 1, 2, 3)""",
)

# ---- evaluation ----------------------------------------------------------------------------------

SCORES = """SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, LEAST(value / 500, 1.0::DOUBLE) AS p,
    CAST(date_trunc('week', ts) AS DATE) AS event_week, CAST(user_id % 3 AS VARCHAR) AS segment FROM events"""


def curve_ctes(group: str) -> dict[str, str]:
    """Pairwise curve: distinct scores with running sums per group."""
    by = f"PARTITION BY {group} " if group else ""
    g = f"{group}, " if group else ""
    return {
        "sc": SCORES,
        "dp": f"SELECT {g}p, COUNT(*) AS n, SUM(y) AS tp FROM sc GROUP BY {g}p",
        "cv": f"""SELECT *, SUM(n) OVER ({by}ORDER BY p DESC) AS cn, SUM(tp) OVER ({by}ORDER BY p DESC) AS ctp,
            SUM(tp) OVER ({by}) AS pos, SUM(n) OVER ({by}) AS tot FROM dp""",
    }


METRIC_COLUMNS = """SUM(n) AS rows, CAST(SUM(tp) AS DOUBLE) / SUM(n) AS positive_rate,
    SUM((n - tp) * (ctp - tp / 2.0)) / NULLIF(MAX(pos) * (MAX(tot) - MAX(pos)), 0)::DOUBLE AS roc_auc,
    SUM(tp * ctp / cn::DOUBLE) / NULLIF(MAX(pos), 0) AS avg_precision,
    SUM(tp * (p - 1) * (p - 1) + (n - tp) * p * p) / SUM(n) AS brier_score"""
ALL_SCORES = with_(**curve_ctes(""), m=f"SELECT {METRIC_COLUMNS} FROM cv")
add("roc_auc", ALL_SCORES, "r:roc_auc", "m")
add("avg_precision", ALL_SCORES, "r:avg_precision", "m")
add("brier", with_(sc=SCORES), "r:brier_score", "(SELECT AVG((p - y) * (p - y)) AS brier_score FROM sc)")
add(
    "weekly_backtest",
    with_(**curve_ctes("event_week"), m=f"SELECT event_week, {METRIC_COLUMNS} FROM cv GROUP BY 1"),
    "d:event_week i:rows r:positive_rate r:roc_auc r:avg_precision r:brier_score",
    "m",
)
_EDGES = ", ".join(str(i / 10) for i in range(11))
BINS = {
    "sc": SCORES,
    "ed": f"SELECT DISTINCT UNNEST(quantile_cont(p, [{_EDGES}])) AS e FROM sc",
    "bn": """SELECT y, p, (SELECT COUNT(*) FROM ed WHERE e < sc.p AND e > (SELECT MIN(e) FROM ed)) AS bin FROM sc""",
    "cal": """SELECT bin, COUNT(*) AS count, AVG(p) AS mean_predicted, AVG(y) AS observed_rate, AVG(p) - AVG(y) AS calibration_gap
        FROM bn GROUP BY 1""",
}
add("calibration", with_(**BINS), "i:bin i:count r:mean_predicted r:observed_rate r:calibration_gap", "cal")
add("ece", with_(**BINS), "r:ece", "(SELECT SUM(count * ABS(calibration_gap)) / SUM(count) AS ece FROM cal)")
RANKED = {
    "sc": SCORES,
    "rk": "SELECT *, ROW_NUMBER() OVER (ORDER BY p DESC, id) AS rn, COUNT(*) OVER () AS tot, SUM(y) OVER () AS pos FROM sc",
    "tk": """SELECT k, LEAST(k, MAX(tot)) AS cohort_size, SUM(y) FILTER (rn <= k) AS true_positives_in_top_k, MAX(pos) AS pos,
        CAST(MAX(pos) AS DOUBLE) / MAX(tot) AS base_positive_rate FROM rk, (VALUES (100), (250), (500), (1000)) q(k) GROUP BY k""",
}
_HIT = "CAST(true_positives_in_top_k AS DOUBLE)"
add(
    "ranking_at_k",
    with_(**RANKED),
    "i:k i:cohort_size i:true_positives_in_top_k r:precision_at_k r:recall_at_k r:lift_at_k r:base_positive_rate",
    f"(SELECT *, {_HIT} / cohort_size AS precision_at_k, {_HIT} / pos AS recall_at_k, {_HIT} / cohort_size / base_positive_rate AS lift_at_k FROM tk)",
)
add("precision_at_k", with_(**RANKED), "i:k r:precision_at_k", f"(SELECT k, {_HIT} / cohort_size AS precision_at_k FROM tk WHERE k = 500)")
_QS = ", ".join(str(q) for q in THRESHOLD_QUANTILES)
add(
    "threshold_capacity",
    with_(sc=SCORES, th=f"SELECT DISTINCT UNNEST(quantile_cont(p, [{_QS}])) AS score_threshold FROM sc"),
    "r:score_threshold i:expected_cohort_size r:expected_precision",
    """(SELECT score_threshold, COUNT(*) AS expected_cohort_size, AVG(y) AS expected_precision FROM th JOIN sc ON p >= score_threshold GROUP BY 1)""",
)
_F1 = "2 * pr * rc / (pr + rc + 1e-8)"


def report(group: str) -> tuple[str, str]:
    g = f"{group}, " if group else ""
    join = f"USING ({group})" if group else "ON TRUE"
    by = f"PARTITION BY {group} " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    ctes = {
        **curve_ctes(group),
        "m": f"SELECT {g}{METRIC_COLUMNS} FROM cv{tail}",
        "pt": f"SELECT {g}p, pr, rc, {_F1} AS f1 FROM (SELECT *, ctp / cn::DOUBLE AS pr, ctp / pos::DOUBLE AS rc FROM cv)",
        "op": f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER ({by}ORDER BY f1 DESC, p) AS rn FROM pt) WHERE rn = 1",
        "cm": f"""SELECT {g}COUNT(*) FILTER (y = 0 AND p < 0.25) AS tn, COUNT(*) FILTER (y = 0 AND p >= 0.25) AS fp,
            COUNT(*) FILTER (y = 1 AND p < 0.25) AS fn, COUNT(*) FILTER (y = 1 AND p >= 0.25) AS tp FROM sc{tail}""",
    }
    source = f"""(SELECT *, (precision_0 + precision_1) / 2 AS macro_precision, (recall_0 + recall_1) / 2 AS macro_recall,
        (f1_0 + f1_1) / 2 AS macro_f1, (precision_0 * support_0 + precision_1 * support_1) / (support_0 + support_1) AS weighted_precision,
        (recall_0 * support_0 + recall_1 * support_1) / (support_0 + support_1) AS weighted_recall,
        (f1_0 * support_0 + f1_1 * support_1) / (support_0 + support_1) AS weighted_f1 FROM (
        SELECT *, COALESCE(2 * precision_0 * recall_0 / NULLIF(precision_0 + recall_0, 0), 0) AS f1_0,
            COALESCE(2 * precision_1 * recall_1 / NULLIF(precision_1 + recall_1, 0), 0) AS f1_1 FROM (
        SELECT {g}m.rows, roc_auc, avg_precision, op.pr AS precision_at_threshold, op.rc AS recall_at_threshold, op.f1 AS f1_at_threshold,
            op.p AS optimal_threshold, tn, fp, fn, tp, tn + fp AS support_0, tp + fn AS support_1,
            COALESCE(tn / NULLIF(tn + fn, 0)::DOUBLE, 0) AS precision_0, COALESCE(tn / NULLIF(tn + fp, 0)::DOUBLE, 0) AS recall_0,
            COALESCE(tp / NULLIF(tp + fp, 0)::DOUBLE, 0) AS precision_1, COALESCE(tp / NULLIF(tp + fn, 0)::DOUBLE, 0) AS recall_1,
            (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy
        FROM m JOIN op {join} JOIN cm {join})))"""
    return with_(**ctes), source


REPORT_SPEC = (
    "i:rows r:roc_auc r:avg_precision r:precision_at_threshold r:recall_at_threshold r:f1_at_threshold r:optimal_threshold i:tn i:fp i:fn i:tp "
    "r:precision_0 r:recall_0 r:f1_0 i:support_0 r:precision_1 r:recall_1 r:f1_1 i:support_1 r:accuracy r:macro_precision r:macro_recall "
    "r:macro_f1 r:weighted_precision r:weighted_recall r:weighted_f1"
)
add("threshold_report", report("")[0], REPORT_SPEC, report("")[1])
add("segment_report", report("segment")[0], f"segment {REPORT_SPEC}", report("segment")[1])
add(
    "label_rate",
    with_(sc=SCORES),
    "d:event_week segment i:rows r:positive_rate",
    "(SELECT event_week, segment, COUNT(*) AS rows, AVG(y) AS positive_rate FROM sc GROUP BY 1, 2)",
)
add(
    "label_rate_by_week",
    with_(sc=SCORES),
    "d:event_week i:rows r:positive_rate",
    "(SELECT event_week, COUNT(*) AS rows, AVG(y) AS positive_rate FROM sc GROUP BY 1)",
)
add(
    "last_period_split",
    with_(sc=SCORES),
    "part i:rows r:positive_rate",
    """(SELECT CASE WHEN event_week = (SELECT MAX(event_week) FROM sc) THEN 'test' ELSE 'train' END AS part, COUNT(*) AS rows,
        AVG(y) AS positive_rate FROM sc GROUP BY 1)""",
)
add(
    "stratified_split",
    with_(sc=SCORES, n="SELECT y AS is_churned, COUNT(*) AS n FROM sc GROUP BY 1"),
    "part i:is_churned i:rows",
    """(SELECT 'test' AS part, is_churned, CAST(ROUND(n * 0.2) AS BIGINT) AS rows FROM n
        UNION ALL SELECT 'train', is_churned, n - CAST(ROUND(n * 0.2) AS BIGINT) FROM n)""",
)
MEASURES_BY_QUARTER = f"""SELECT {start_of('quarter', 'o_orderdate')} AS event_week, r_name AS country_code,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'newbie' ELSE 'active' END AS segment, o_totalprice AS total, CAST(o_orderkey % 7 AS DOUBLE) AS spread,
    CASE WHEN month(o_orderdate) > 3 THEN c_acctbal END AS partly_known FROM orders JOIN home ON o_custkey = c_custkey"""


def drift_sql(by: str) -> str:
    g = f", {by}" if by else ""
    part = f"PARTITION BY {by} " if by else ""
    diffs = ", ".join(
        f"ABS({c} - LAG({c}) OVER ({part}ORDER BY event_week)) AS {c}" for c in ("total", "spread", "partly_known")
    )
    return f"""(SELECT event_week{g}, CASE WHEN total IS NULL THEN 0 ELSE 1 END + CASE WHEN spread IS NULL THEN 0 ELSE 1 END
            + CASE WHEN partly_known IS NULL THEN 0 ELSE 1 END AS feature_count_compared,
        (COALESCE(total, 0) + COALESCE(spread, 0) + COALESCE(partly_known, 0))
            / NULLIF((total IS NOT NULL)::INT + (spread IS NOT NULL)::INT + (partly_known IS NOT NULL)::INT, 0) AS feature_drift_mean_abs,
        GREATEST(total, spread, partly_known) AS feature_drift_max_abs
        FROM (SELECT event_week{g}, {diffs}, ROW_NUMBER() OVER ({part}ORDER BY event_week) AS rn FROM
            (SELECT event_week{g}, AVG(total) AS total, AVG(spread) AS spread, AVG(partly_known) AS partly_known FROM q GROUP BY ALL))
        WHERE rn > 1)"""


DRIFT_SPEC = "i:feature_count_compared r:feature_drift_mean_abs r:feature_drift_max_abs"
add("feature_drift", with_("home", q=MEASURES_BY_QUARTER), f"d:event_week {DRIFT_SPEC}", drift_sql(""))
add(
    "feature_drift_by_segment",
    with_("home", q=MEASURES_BY_QUARTER),
    f"d:event_week country_code segment {DRIFT_SPEC}",
    drift_sql("country_code, segment"),
)

# ---- scoring -------------------------------------------------------------------------------------

FEATURES = (
    "total_orders_cpo_W0",
    "no_shows_W0",
    "hours_worked_W0",
    "avg_sp_distance_google_W0",
    "perc_stacking_W0",
    "contacts_total_tickets_W0",
    "cdt_wow_delta_W0_W1",
    "total_earnings_W0",
    "holiday_days_in_week_W0",
)
RIDERS = """SELECT h.rider_id, r_name AS country_code, n_name AS city_code,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'newbie' ELSE 'active' END AS segment,
    LEAST(GREATEST((c_acctbal + 1000) / 11000, 0), 1) AS churn_probability,
    x.* EXCLUDE (rider_id), o.total_earnings_W0, 1 AS holiday_days_in_week_W0
    FROM home h LEFT JOIN (SELECT rider_id, COUNT(DISTINCT o_orderkey) AS total_orders_cpo_W0,
        COUNT(*) FILTER (l_returnflag = 'R') AS no_shows_W0, SUM(l_quantity) AS hours_worked_W0,
        AVG(l_extendedprice) AS avg_sp_distance_google_W0, AVG(l_linenumber) AS perc_stacking_W0,
        AVG(l_discount) AS contacts_total_tickets_W0, AVG(l_tax) AS cdt_wow_delta_W0_W1 FROM ol GROUP BY 1) x ON x.rider_id = h.rider_id
    LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS rider_id, SUM(o_totalprice) AS total_earnings_W0 FROM orders GROUP BY 1) o
      ON o.rider_id = h.rider_id"""


def z(f: str) -> str:
    sign = "-1" if any(p in f.lower() for p in PROTECTIVE_KEYWORDS) else "1"
    return f"COALESCE({sign} * ({f} - AVG({f}) OVER ()) / NULLIF(stddev_pop({f}) OVER (), 0), 0)"


CONTRIB = "SELECT rider_id, country_code, city_code, segment, churn_probability, " + ", ".join(f"{z(f)} AS {f}" for f in FEATURES) + " FROM rd"


def category(name: str) -> str:
    cols = [f for f in FEATURES if any(p in f.lower() for p in CATEGORY_KEYWORDS[name])]
    if not cols:
        return "0.0"
    return "(" + " + ".join(f"GREATEST({c}, 0)" for c in cols) + f") / {float(len(cols))}"


_CATS = list(CATEGORY_KEYWORDS)
_CAT_SQL = ", ".join(f'{category(c)} AS "cat__{c}"' for c in _CATS)
_UNPIVOT = " UNION ALL ".join(f"SELECT rider_id, '{f}' AS feature, {f} AS impact_score FROM ct" for f in FEATURES)
SCORED = {
    "rd": RIDERS,
    "ct": CONTRIB,
    "lg": _UNPIVOT,
    "td": """SELECT *, ROW_NUMBER() OVER (PARTITION BY rider_id ORDER BY impact_score DESC, feature) - 1 AS pos FROM lg WHERE impact_score > 0
        QUALIFY pos < 5""",
}
add(
    "risk_rank_dense",
    with_("ol", "home", rd=RIDERS),
    "rider_id city_code segment r:churn_probability is_high_risk i:risk_rank",
    "(SELECT *, churn_probability >= 0.5 AS is_high_risk, DENSE_RANK() OVER (ORDER BY churn_probability DESC) AS risk_rank FROM rd)",
)
add(
    "risk_rank_rows",
    with_("ol", "home", rd=RIDERS),
    "rider_id r:churn_probability i:risk_rank",
    "(SELECT *, ROW_NUMBER() OVER (ORDER BY churn_probability DESC, rider_id) AS risk_rank FROM rd)",
)
TOP = """SELECT *, ROW_NUMBER() OVER (PARTITION BY country_code ORDER BY churn_probability DESC, rider_id) AS group_rank,
    COUNT(*) OVER (PARTITION BY country_code) AS group_rows,
    GREATEST(1, CEIL(COUNT(*) OVER (PARTITION BY country_code) * 0.1::DOUBLE)) AS top_rows FROM rd QUALIFY group_rank <= top_rows"""
add(
    "risk_top_fraction",
    with_("ol", "home", rd=RIDERS, tp=TOP),
    "rider_id country_code i:group_rank i:group_rows i:top_rows",
    "tp",
)
add(
    "city_summary",
    with_("ol", "home", rd=RIDERS),
    "city_code i:total_couriers i:high_risk_count r:avg_churn_prob r:high_risk_pct i:predicted_fleet_30d",
    """(SELECT city_code, COUNT(*) AS total_couriers, COUNT(*) FILTER (churn_probability >= 0.5) AS high_risk_count,
        AVG(churn_probability) AS avg_churn_prob, round_even(100.0 * COUNT(*) FILTER (churn_probability >= 0.5) / COUNT(*), 1) AS high_risk_pct,
        COUNT(*) FILTER (churn_probability < 0.5) AS predicted_fleet_30d FROM rd GROUP BY 1)""",
)
add("contributions_z", with_("ol", "home", rd=RIDERS, ct=CONTRIB), "rider_id " + " ".join(f"r:{f}" for f in FEATURES), "ct")
_SQL["category_scores"] = (
    with_("ol", "home", rd=RIDERS, ct=CONTRIB)
    + "\nSELECT rider_id, "
    + ", ".join(f'{rounded(category(c))} AS "cat__{c}"' for c in _CATS)
    + " FROM ct"
)
add("top_drivers", with_("ol", "home", **SCORED), "rider_id i:pos feature r:impact_score", "td")
SIGNALS = """SELECT *, ROW_NUMBER() OVER (PARTITION BY country_code, city_code ORDER BY impact_score DESC, feature) AS signal_rank FROM
    (SELECT country_code, city_code, feature, SUM(impact_score) AS impact_score FROM td JOIN {members} USING (rider_id) GROUP BY 1, 2, 3)
    QUALIFY signal_rank <= 5"""
add(
    "city_signals",
    with_("ol", "home", **SCORED, sg=SIGNALS.format(members="rd")),
    "country_code city_code feature r:impact_score i:signal_rank",
    "sg",
)
_DRIVER = "CASE " + " ".join(f"WHEN contains(lower(feature), '{p}') THEN '{d}'" for p, d in DRIVER_OF_FEATURE) + " END"
_BOOK = ", ".join("('" + "', '".join(v.replace("'", "''") for v in row) + "')" for row in DRIVER_PLAYBOOK)
add(
    "driver_actions",
    with_(
        "ol",
        "home",
        **SCORED,
        dv=f"SELECT rider_id, {_DRIVER} AS driver, MIN(pos) AS first_pos FROM td GROUP BY 1, 2",
        pk="SELECT *, ROW_NUMBER() OVER (PARTITION BY rider_id ORDER BY first_pos) - 1 AS pos FROM dv WHERE driver IS NOT NULL QUALIFY pos < 3",
        bk=f"SELECT * FROM (VALUES {_BOOK}) b(driver, action, owner, effort)",
    ),
    "rider_id i:pos driver action owner effort",
    "(SELECT * FROM pk JOIN bk USING (driver))",
)
_CAT_AVG = ", ".join(f'AVG("cat__{c}") AS "cat__{c}"' for c in _CATS)
_CAT_ROWS = " UNION ALL ".join(
    f"""SELECT country_code, city_code, '{c}' AS category, {i} AS ci, "cat__{c}" AS impact_score FROM cy""" for i, c in enumerate(_CATS)
)
PLAN = {
    **SCORED,
    "tp": TOP,
    "cx": f"SELECT *, {_CAT_SQL} FROM ct",
    "cy0": f"""SELECT tp.country_code, tp.city_code, MAX(group_rows) AS total_riders_week, MAX(top_rows) AS top_decile_riders,
        COUNT(*) AS riders_in_top_decile, AVG(tp.churn_probability) AS avg_churn_probability,
        COUNT(*) FILTER (tp.segment = 'newbie') AS newbie_high_risk_count, {_CAT_AVG}
        FROM tp JOIN cx USING (rider_id) GROUP BY 1, 2""",
    "cy": """SELECT *, ROW_NUMBER() OVER (PARTITION BY country_code ORDER BY riders_in_top_decile DESC, city_code) AS city_rank FROM cy0
        QUALIFY city_rank <= 3""",
    "cr": f"""SELECT *, ROW_NUMBER() OVER (PARTITION BY country_code, city_code ORDER BY impact_score DESC, ci) AS rn FROM ({_CAT_ROWS}) QUALIFY rn <= 3""",
    "cg": "SELECT country_code, city_code, string_agg(category, '|' ORDER BY rn) AS categories FROM cr GROUP BY 1, 2",
    "sg": SIGNALS.format(members="tp"),
    "sl": "SELECT country_code, city_code, string_agg(feature, '|' ORDER BY signal_rank) AS signals FROM sg GROUP BY 1, 2",
}
add(
    "country_context",
    with_("ol", "home", **PLAN),
    "country_code city_code i:city_rank i:total_riders_week i:top_decile_riders i:riders_in_top_decile r:share_of_country_top_decile "
    "r:avg_churn_probability categories signals i:newbie_high_risk_count r:newbie_gac_exposure i:samples",
    """(SELECT cy.*, riders_in_top_decile / top_decile_riders::DOUBLE AS share_of_country_top_decile, categories, COALESCE(signals, '') AS signals,
        newbie_high_risk_count * 10.0 AS newbie_gac_exposure, LEAST(riders_in_top_decile, 25) AS samples
        FROM cy LEFT JOIN cg USING (country_code, city_code) LEFT JOIN sl USING (country_code, city_code))""",
)
_TOPICS = ", ".join(f"('{t}', '{p}')" for t, parts in TOPIC_KEYWORDS.items() for p in parts)
_BONUS = "CASE lower(trim(estimated_cost)) " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in COST_BONUS.items()) + " ELSE 0 END"
MATCH = {
    **PLAN,
    "bk": PLAYBOOK,
    "tk": f"SELECT * FROM (VALUES {_TOPICS}) t(topic, part)",
    "ctop": """SELECT DISTINCT country_code, city_code, topic FROM cy LEFT JOIN cg USING (country_code, city_code) LEFT JOIN sl USING (country_code, city_code)
        JOIN tk ON contains(lower(replace(categories, '|', ' ')), part) OR contains(lower(replace(COALESCE(signals, ''), '|', ' ')), part)""",
    "btop": "SELECT DISTINCT row_no, topic FROM bk JOIN tk ON contains(lower(impact || ' ' || metric || ' ' || action), part)",
    "hits": "SELECT country_code, city_code, row_no, COUNT(*) AS overlap FROM ctop JOIN btop USING (topic) GROUP BY 1, 2, 3",
    "sco": f"""SELECT cy.country_code, cy.city_code, bk.*, COALESCE(overlap, 0) + {_BONUS} AS match_score FROM cy CROSS JOIN bk
        LEFT JOIN hits ON hits.country_code = cy.country_code AND hits.city_code = cy.city_code AND hits.row_no = bk.row_no""",
    "dis": """SELECT * FROM sco QUALIFY ROW_NUMBER() OVER (PARTITION BY country_code, city_code, action ORDER BY match_score DESC, row_no) = 1""",
    "pm": """SELECT *, ROW_NUMBER() OVER (PARTITION BY country_code, city_code ORDER BY match_score DESC, row_no) - 1 AS pos FROM dis QUALIFY pos < 5""",
}
add(
    "playbook_match",
    with_("ol", "home", **MATCH),
    "country_code city_code i:pos action owner estimated_cost r:match_score",
    "pm",
)
add(
    "action_payload",
    with_("ol", "home", **PLAN),
    "event_type country_code name city_code i:riders_in_top_decile",
    "(SELECT 'weekly_rider_churn_actions' AS event_type, 'boosted_trees' AS name, * FROM cy)",
)
add(
    "importance_cumshare",
    "",
    "feature r:importance r:cumulative_importance",
    """(SELECT CAST(p_partkey AS VARCHAR) AS feature, p_retailprice AS importance,
        SUM(p_retailprice) OVER (ORDER BY p_retailprice DESC, CAST(p_partkey AS VARCHAR) ROWS UNBOUNDED PRECEDING) / SUM(p_retailprice) OVER ()
        AS cumulative_importance FROM part)""",
)

# ---- correlation ---------------------------------------------------------------------------------

KPI_METRICS = (
    "no_shows", "shifts_done", "all_shifts", "hours_worked", "perc_no_show", "total_orders_cpo", "total_bw_orders", "total_earnings",
    "cpo_local_currency", "net_cpo_lc", "perc_stacking", "avg_sp_distance_google", "avg_pd_distance_google", "avg_total_distance_google",
    "at_customer_time_in_minutes", "at_vendor_time_in_minutes", "cdt", "perc_reas", "earning_per_hour",
)
KPI = {
    "paid": PAID,
    "k": shifts_cte("week", "3600.0", ""),
    "m": f"""SELECT 'ALL' AS country_code, city_code, zone_name, rider_id, {start_of('week', 'oday')} AS week,
        {delivery_columns('COUNT(*) FILTER (l_tax > 0 AND l_discount <> 0)')} FROM paid GROUP BY ALL""",
    "kw": f"""SELECT m.*, {ratio('total_earnings', 'hours_worked')} AS earning_per_hour, no_shows, shifts_done, all_shifts, hours_worked, perc_no_show
        FROM m LEFT JOIN k USING (rider_id, week)""",
    "kr": "SELECT rider_id, COUNT(DISTINCT week) AS weeks_observed, " + ", ".join(f"AVG({c}) AS {c}" for c in KPI_METRICS) + " FROM kw GROUP BY 1",
}
add("kpi_rider_means", with_(*ALL_BASE, **KPI), "rider_id i:weeks_observed " + " ".join(f"r:{c}" for c in KPI_METRICS), "kr")
CONTACTS = {
    "tr": REASONS,
    "tn": """SELECT contact_reason_code FROM (SELECT contact_reason_code, SUM(ticket_count) AS n FROM tr GROUP BY 1) ORDER BY n DESC, contact_reason_code LIMIT 12""",
    "tb": """SELECT rider_id, CASE WHEN contact_reason_code IN (SELECT contact_reason_code FROM tn) THEN contact_reason_code ELSE 'other_reason' END AS bucket,
        ticket_count FROM tr""",
    "cp": """SELECT rider_id, 'contact_' || bucket AS reason, SUM(n) AS value FROM (
            SELECT r.rider_id, b.bucket, COALESCE(SUM(ticket_count), 0) AS n FROM (SELECT DISTINCT rider_id FROM tb) r
            CROSS JOIN (SELECT contact_reason_code AS bucket FROM tn UNION SELECT 'other_reason') b
            LEFT JOIN tb ON tb.rider_id = r.rider_id AND tb.bucket = b.bucket GROUP BY 1, 2) GROUP BY 1, 2
        UNION ALL SELECT rider_id, 'total_tickets', SUM(ticket_count) FROM tb GROUP BY 1""",
}
add("contact_topn_pivot", with_("ev", **CONTACTS), "rider_id reason r:value", "cp")
_SLUG = "regexp_replace(lower({}), '\\W+', '_', 'g')"
VIOLATIONS = {
    "va": TYPE_ACTION,
    "vn": f"SELECT rider_id, 'compliance_' || {_SLUG.format('violation_type')} || '_' || {_SLUG.format('action_type')} AS name, violations_count FROM va",
    "vp": """SELECT r.rider_id, n.name, COALESCE(SUM(violations_count), 0) AS value FROM (SELECT DISTINCT rider_id FROM vn) r
        CROSS JOIN (SELECT DISTINCT name FROM vn) n LEFT JOIN vn ON vn.rider_id = r.rider_id AND vn.name = n.name GROUP BY 1, 2
        UNION ALL SELECT rider_id, 'total_violations', SUM(violations_count) FROM vn GROUP BY 1""",
}
add("violation_pivot", with_("ev", **VIOLATIONS), "rider_id name r:value", "vp")
add(
    "ever_flag",
    "",
    "rider_id i:is_churned r:tenure_days",
    """(SELECT CAST(user_id AS VARCHAR) AS rider_id, MAX(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS is_churned,
        AVG(value) AS tenure_days FROM events GROUP BY 1)""",
)
MERGED = {
    **KPI,
    **CONTACTS,
    **VIOLATIONS,
    "sn": snapshot_cte("week", 30),
    "lf": "SELECT rider_id, feature, value FROM (UNPIVOT (SELECT rider_id, CAST(weeks_observed AS DOUBLE) AS weeks_observed, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in KPI_METRICS)
    + " FROM kr) ON COLUMNS(* EXCLUDE (rider_id)) INTO NAME feature VALUE value)",
    "al": """SELECT * FROM lf
        UNION ALL SELECT cp.rider_id, reason, value / GREATEST(7 * weeks_observed, 1)::DOUBLE FROM cp JOIN kr USING (rider_id)
        UNION ALL SELECT vp.rider_id, name, value / GREATEST(7 * weeks_observed, 1)::DOUBLE FROM vp JOIN kr USING (rider_id)
        UNION ALL SELECT sn.rider_id, 'tenure_days', sn.tenure_days FROM sn JOIN kr USING (rider_id)
        UNION ALL SELECT sn.rider_id, 'days_since_last_slot', sn.days_since_last_slot FROM sn JOIN kr USING (rider_id)""",
}
add(
    "target_correlation",
    with_(*ALL_BASE, **MERGED),
    "feature r:pearson_r",
    """(SELECT feature, CASE WHEN stddev_pop(value) > 0 AND stddev_pop(is_churned) > 0 THEN
            covar_pop(value, is_churned) / (stddev_pop(value) * stddev_pop(is_churned)) END AS pearson_r
        FROM al JOIN sn USING (rider_id) GROUP BY 1)""",
)
_CM = ("no_shows", "hours_worked", "total_earnings", "cdt", "perc_reas")
_SQL["correlation_matrix"] = with_(*ALL_BASE, **KPI) + "\n" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {rounded(f'corr({a}, {b})')} AS pearson_r FROM kr" for a in _CM for b in _CM
)
add(
    "exposure_normalise",
    with_(*ALL_BASE, **KPI, t=tickets_cte("week", "")),
    "rider_id r:total_tickets",
    """(SELECT t.rider_id, SUM(contacts_total_tickets) / MAX(COALESCE(GREATEST(7 * weeks_observed, 1), 7))::DOUBLE AS total_tickets
        FROM t LEFT JOIN kr USING (rider_id) GROUP BY 1)""",
)

# ---- lifetime features ---------------------------------------------------------------------------

LIFE = {
    "ro": f"""SELECT rider_id, oday, {days(AS_OF, 'oday')} AS age, l_extendedprice / 100 AS pay, l_linenumber, l_tax, l_discount, l_quantity,
        l_returnflag, l_linestatus FROM ol""",
    "rs": f"""SELECT CAST(o_custkey AS VARCHAR) AS rider_id, CAST(o_orderdate AS DATE) AS day, {days(AS_OF, 'CAST(o_orderdate AS DATE)')} AS age,
        o_orderstatus = 'P' AS missed, o_orderkey % 24 AS hr, 1 + o_orderkey % 5 AS hours FROM orders""",
    "rc": f"SELECT *, {days(AS_OF, 'CAST(moved AS DATE)')} AS age FROM ev WHERE CAST(moved AS DATE) <= {AS_OF}",
}


def trend(a: str, b: str) -> str:
    return f"(({a}) - ({b})) / NULLIF(CAST(({b}) AS DOUBLE), 0)"


def within(expr: str, lo: int, hi: int) -> str:
    return f"COALESCE(SUM({expr}) FILTER (age >= {lo} AND age < {hi}), 0)"


EARN = {
    "eo": f"""SELECT rider_id, COUNT(*) AS total_orders, COUNT(*) FILTER (age < 7) AS orders_last_7d, COUNT(*) FILTER (age < 14) AS orders_last_14d,
        COUNT(*) FILTER (age < 30) AS orders_last_30d, SUM(pay) AS total_earnings, COUNT(DISTINCT oday) AS nd,
        COUNT(DISTINCT date_trunc('week', oday)) AS nw, {within('pay', 0, 7)} AS p0, {within('pay', 7, 14)} AS p1,
        COUNT(*) FILTER (l_linenumber > 1) AS st, COUNT(*) FILTER (l_tax > 0.05::DOUBLE) AS rush FROM ro GROUP BY 1""",
    "es": f"""SELECT rider_id, SUM(CASE WHEN missed THEN 0 ELSE hours END) AS th, COUNT(DISTINCT day) FILTER (NOT missed) AS wd,
        {within('CASE WHEN missed THEN 0 ELSE hours END', 0, 7)} AS h0, {within('CASE WHEN missed THEN 0 ELSE hours END', 7, 14)} AS h1 FROM rs GROUP BY 1""",
}
EARN_SPEC = (
    "i:total_orders i:orders_last_7d i:orders_last_14d i:orders_last_30d r:total_earnings r:earnings_per_hour r:earnings_per_day "
    "r:earnings_per_week r:earnings_trend_7d r:pct_stacked_orders r:pct_rush_bonus r:avg_hours_per_day r:hours_trend_7d"
)
EARN_SQL = f"""SELECT eo.*, {ratio('total_earnings', 'th')} AS earnings_per_hour, total_earnings / nd AS earnings_per_day, total_earnings / nw AS earnings_per_week,
    {trend(ratio('p0', 'h0'), ratio('p1', 'h1'))} AS earnings_trend_7d, {ratio('st', 'total_orders')} AS pct_stacked_orders,
    {ratio('rush', 'total_orders')} AS pct_rush_bonus, {ratio('th', 'wd')} AS avg_hours_per_day, {trend('h0', 'h1')} AS hours_trend_7d
    FROM eo LEFT JOIN es USING (rider_id)"""
add("earnings_windows", with_("ol", **{k: LIFE[k] for k in ("ro", "rs")}, **EARN), f"rider_id {EARN_SPEC}", f"({EARN_SQL})")
_TREND_ROWS = " UNION ALL ".join(
    f"""SELECT rider_id, '{m}' AS metric, {w} AS "window", {now} AS current_value, {before} AS previous_value FROM ro GROUP BY 1"""
    for w in (7, 14, 28)
    for m, now, before in (
        ("orders", f"CAST(COUNT(*) FILTER (age < {w}) AS DOUBLE)", f"CAST(COUNT(*) FILTER (age >= {w} AND age < {2 * w}) AS DOUBLE)"),
        ("earnings", within("pay", 0, w), within("pay", w, 2 * w)),
        ("earnings_per_order", f"AVG(pay) FILTER (age < {w})", f"AVG(pay) FILTER (age >= {w} AND age < {2 * w})"),
    )
)
add(
    "earnings_trends",
    with_("ol", ro=LIFE["ro"]),
    "rider_id metric i:window r:current_value r:previous_value r:pct_change",
    f"(SELECT *, {trend('current_value', 'previous_value')} AS pct_change FROM ({_TREND_ROWS}))",
)


def experience_sql(r: int) -> dict[str, str]:
    return {
        "xo": """SELECT rider_id, COUNT(*) FILTER (l_tax < 0.015::DOUBLE) / COUNT(*)::DOUBLE AS pct_bw_orders, COUNT(*) FILTER (l_linenumber > 1) / COUNT(*)::DOUBLE AS pct_stacked,
            AVG(l_quantity / 10) AS avg_total_distance_km, AVG(l_quantity / 30) AS avg_sp_distance_km,
            AVG(l_quantity / 15) FILTER (l_returnflag <> 'N') AS avg_pd_distance_km, AVG(l_quantity * 2) AS avg_cdt_minutes,
            AVG(l_discount * 100) AS avg_waiting_pickup_min, AVG(l_tax * 100) AS avg_waiting_delivery_min, AVG(l_linenumber) AS avg_batch_number FROM ro GROUP BY 1""",
        "xc": f"""SELECT rider_id, COUNT(*) / COUNT(DISTINCT date_trunc('week', moved))::DOUBLE AS avg_contacts_per_week,
            {trend(f'COUNT(*) FILTER (age < {r})', f'COUNT(*) FILTER (age >= {r} AND age < {2 * r})')} AS contact_trend,
            AVG(value) FILTER (k % 10 <> 0) AS avg_rsat,
            {trend(f'AVG(value) FILTER (k % 10 <> 0 AND age < {r})', f'AVG(value) FILTER (k % 10 <> 0 AND age >= {r} AND age < {2 * r})')} AS rsat_trend
            FROM rc GROUP BY 1""",
        "xs": "SELECT rider_id, COUNT(*) FILTER (hr IN (12, 13, 14, 19, 20, 21)) / COUNT(*)::DOUBLE AS pct_peak_slots FROM rs GROUP BY 1",
    }


EXP_SPEC = (
    "r:pct_bw_orders r:pct_stacked r:avg_contacts_per_week r:contact_trend r:avg_rsat r:rsat_trend r:avg_total_distance_km r:avg_sp_distance_km "
    "r:avg_pd_distance_km r:avg_cdt_minutes r:avg_waiting_pickup_min r:avg_waiting_delivery_min r:avg_batch_number r:pct_peak_slots"
)
add(
    "experience",
    with_("ev", "ol", **LIFE, **experience_sql(15)),
    f"rider_id {EXP_SPEC}",
    "(SELECT * FROM xo LEFT JOIN xc USING (rider_id) LEFT JOIN xs USING (rider_id))",
)
add(
    "contact_trend",
    with_(
        "ev",
        rc=LIFE["rc"],
        c=f"""SELECT rider_id, COUNT(*) AS total_contacts, COUNT(*) FILTER (age < 15) AS contacts_recent, COUNT(*) FILTER (age >= 15 AND age < 30) AS contacts_prior,
            COUNT(*) FILTER (k % 3 = 0) / COUNT(*)::DOUBLE AS pct_negative_outcome, COUNT(*) FILTER (k % 3 = 1) / COUNT(*)::DOUBLE AS pct_resolved,
            COUNT(DISTINCT k % 9) AS distinct_reasons FROM rc GROUP BY 1""",
        n="SELECT rider_id, CASE WHEN k % 9 = 0 THEN 'unknown' ELSE 'reason_' || CAST(k % 9 AS VARCHAR) END AS reason, COUNT(*) AS n FROM rc GROUP BY 1, 2",
        f="SELECT rider_id, reason AS main_reason FROM n QUALIFY ROW_NUMBER() OVER (PARTITION BY rider_id ORDER BY n DESC, reason) = 1",
    ),
    "rider_id i:total_contacts i:contacts_recent i:contacts_prior r:pct_negative_outcome r:pct_resolved i:distinct_reasons main_reason r:contact_trend",
    f"(SELECT *, {trend('contacts_recent', 'contacts_prior')} AS contact_trend FROM c JOIN f USING (rider_id))",
)
_FAILS = ", ".join(
    f"COUNT(*) FILTER (l_linestatus = 'O' AND l_linenumber % 4 = {i}) / COUNT(*)::DOUBLE AS pct_fail_{w}"
    for i, w in enumerate(("courier", "customer", "vendor", "tech"))
)


def engagement_sql(r: int) -> dict[str, str]:
    def share(lo: int, hi: int) -> str:
        return ratio(f"COUNT(*) FILTER (missed AND age >= {lo} AND age < {hi})", f"COUNT(*) FILTER (age >= {lo} AND age < {hi})")

    return {
        "go": f"SELECT rider_id, COUNT(*) AS n_orders, COUNT(*) FILTER (l_returnflag = 'R') / COUNT(*)::DOUBLE AS pct_reassignment, {_FAILS} FROM ro GROUP BY 1",
        "gs": f"""SELECT rider_id, COUNT(*) FILTER (missed) / COUNT(*)::DOUBLE AS pct_no_shows, {trend(share(0, r), share(r, 2 * r))} AS no_show_trend,
            {trend('COUNT(*) FILTER (age < 7)', 'COUNT(*) FILTER (age >= 7 AND age < 14)')} AS slots_booked_trend,
            COUNT(*) FILTER (NOT missed) / COUNT(*)::DOUBLE AS slot_utilization FROM rs GROUP BY 1""",
        "gv": f"""SELECT rider_id, COUNT(*) AS nv, {trend(f'COUNT(*) FILTER (age < {r})', f'COUNT(*) FILTER (age >= {r} AND age < {2 * r})')} AS violation_trend
            FROM rc WHERE event_type = 'error' GROUP BY 1""",
        "gb": """SELECT rider_id, n_name AS city, MIN(CAST(o_orderdate AS DATE)) AS hire_date, c_mktsegment AS vehicle_type,
            'channel_' || CAST(c_custkey % 3 AS VARCHAR) AS onboarding_channel FROM home JOIN orders ON c_custkey = o_custkey GROUP BY ALL""",
        "ge": f"""SELECT gb.*, go.* EXCLUDE (rider_id), gs.* EXCLUDE (rider_id), COALESCE(nv, 0) AS total_violations,
            {ratio('COALESCE(nv, 0)', 'n_orders')} AS violations_per_order, violation_trend
            FROM gb LEFT JOIN go USING (rider_id) LEFT JOIN gs USING (rider_id) LEFT JOIN gv USING (rider_id)""",
    }


add(
    "engagement",
    with_("ev", "ol", "home", **LIFE, **engagement_sql(90)),
    "rider_id r:pct_reassignment r:pct_no_shows r:no_show_trend r:pct_fail_courier r:pct_fail_customer r:pct_fail_vendor r:pct_fail_tech "
    "i:total_violations r:violations_per_order r:violation_trend vehicle_type onboarding_channel r:slots_booked_trend r:slot_utilization",
    "ge",
)
BALANCE = {
    "bb": """SELECT h.rider_id, h.n_name AS city, h.c_acctbal AS avg_cash_balance, quantile_disc(h.c_acctbal, 0.9) OVER (PARTITION BY h.n_name) AS lim
        FROM home h WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
    "bu": "SELECT rider_id, COUNT(*) FILTER (l_discount > 0.085::DOUBLE) / COUNT(*)::DOUBLE AS undelivered_rate FROM ol GROUP BY 1",
    "ba": """SELECT bb.rider_id, avg_cash_balance, CASE WHEN avg_cash_balance > lim THEN 1 ELSE 0 END AS high_cash_balance_flag, undelivered_rate
        FROM bb LEFT JOIN bu USING (rider_id)""",
}
add("balance_risk", with_("ol", "home", **BALANCE), "rider_id r:avg_cash_balance i:high_cash_balance_flag r:undelivered_rate", "ba")
PATTERN = f"""SELECT rider_id, {trend('COUNT(*) FILTER (age < 7)', 'COUNT(*) FILTER (age >= 7 AND age < 14)')} AS slots_booked_trend_7d,
    {trend('COUNT(*) FILTER (age < 14)', 'COUNT(*) FILTER (age >= 14 AND age < 28)')} AS slots_booked_trend_14d, MIN(age) AS days_since_last_booking,
    stddev_samp(gap) AS booking_regularity
    FROM (SELECT *, date_diff('day', LAG(day) OVER (PARTITION BY rider_id ORDER BY day), day) AS gap FROM rs) GROUP BY 1"""
add(
    "feature_matrix",
    with_(
        "ev", "ol", "home", **LIFE, **EARN, ew=EARN_SQL, **experience_sql(28), **engagement_sql(28), **BALANCE, pt=PATTERN
    ),
    f"rider_id city {EARN_SPEC} {EXP_SPEC} r:pct_reassignment r:pct_no_shows r:no_show_trend r:pct_fail_courier r:pct_fail_customer r:pct_fail_vendor "
    "r:slots_booked_trend_7d r:slots_booked_trend_14d i:days_since_last_booking r:booking_regularity r:slot_utilization i:total_violations "
    "r:violations_per_order r:avg_cash_balance i:high_cash_balance_flag r:undelivered_rate vehicle_type onboarding_channel i:tenure_days segment".replace(
        "r:pct_stacked ", ""
    ),
    f"""(SELECT ge.*, ew.* EXCLUDE (rider_id), xo.* EXCLUDE (rider_id), xc.* EXCLUDE (rider_id), xs.* EXCLUDE (rider_id), ba.* EXCLUDE (rider_id),
        pt.* EXCLUDE (rider_id), {days(AS_OF, 'hire_date')} AS tenure_days,
        CASE WHEN {days(AS_OF, 'hire_date')} < 30 THEN 'newbie' ELSE 'active' END AS segment
        FROM ge LEFT JOIN ew ON ew.rider_id = ge.rider_id LEFT JOIN xo ON xo.rider_id = ge.rider_id LEFT JOIN xc ON xc.rider_id = ge.rider_id
        LEFT JOIN xs ON xs.rider_id = ge.rider_id LEFT JOIN ba ON ba.rider_id = ge.rider_id LEFT JOIN pt ON pt.rider_id = ge.rider_id)""",
)

# ---- round trips and streams ---------------------------------------------------------------------

_SQL["csv_roundtrip"] = _SQL["activity_snapshot"]
add(
    "report_sinks",
    with_(sc=SCORES, th=f"SELECT DISTINCT UNNEST(quantile_cont(p, [{_QS}])) AS t FROM sc", **{k: v for k, v in BINS.items() if k != "sc"}),
    "report i:rows",
    """(SELECT 'summary' AS report, 1 AS rows UNION ALL SELECT 'ranking', 4 UNION ALL SELECT 'threshold', COUNT(*) FROM th
        UNION ALL SELECT 'calibration', COUNT(*) FROM cal UNION ALL SELECT 'weekly', COUNT(DISTINCT event_week) FROM sc
        UNION ALL SELECT 'label_rate', COUNT(DISTINCT event_week) FROM sc)""",
)
add(
    "stream_ticket_counts",
    with_("ev", t=REASONS.replace("moved", "ts")),
    "d:week rider_id contact_reason_code i:ticket_count",
    "t",
)
add(
    "stream_last_activity",
    "",
    "rider_id d:last_slot_date",
    """(SELECT CAST(user_id AS VARCHAR) AS rider_id, MAX(CAST(ts AS DATE)) AS last_slot_date FROM events
        WHERE event_type <> 'error' GROUP BY 1)""",
)
