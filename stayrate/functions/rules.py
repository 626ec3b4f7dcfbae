"""Fixed rule tables: labels, keyword families, playbook and calendar."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ticket reason codes and their labels.
REASON_LABELS = {
    "15A.1": "address_change",
    "15A.2": "change_order_details",
    "15A.3": "customer_feedback",
    "15A.4": "id_check",
    "15A.5": "access_customer_premises",
    "15A.6": "refuse_accept_order",
    "15A.7": "unable_contact_customer",
    "15A.8": "unable_find_location",
    "15A.9": "wrong_address",
    "15B.1": "administrative_matter",
    "15B.2": "chat_acknowledgment",
    "15C.1": "checking_order_status",
    "15C.2": "large_order",
    "15C.3": "missing_item",
    "15C.4": "spilled_damaged",
    "15C.5": "stacked_order_dropoff",
    "15D.1": "partner_closed",
    "15D.2": "partner_device_issue",
    "15D.3": "partner_no_order",
    "15D.4": "partner_feedback",
    "15D.5": "access_partner_premises",
    "15D.6": "late_preparation",
    "15D.7": "order_modification",
    "15D.8": "order_taken_other_rider",
    "15D.9": "product_unavailable",
    "15D.10": "partner_refuse_prepare",
    "15D.11": "unable_locate_partner",
    "15E.1": "accident",
    "15E.2": "app_issue",
    "15E.3": "asks_order_assignment",
    "15E.4": "asks_phone_number",
    "15E.5": "break_request",
    "15E.6": "break_status",
    "15E.7": "callback_request",
    "15E.8": "chat_reason_unknown",
    "15E.9": "clicked_through",
    "15E.10": "cod_issue",
    "15E.11": "equipment_issue",
    "15E.12": "end_break",
    "15E.13": "not_willing_order",
    "15E.14": "shift_adjustment",
    "15E.15": "translations_needed",
    "15E.16": "updating_status",
    "20A.1": "not_applicable",
}

# Driver families and the name parts that put a feature into them.
CATEGORY_KEYWORDS = {
    "Earnings Health": ("earnings", "cpo", "eph", "city_median_earnings"),
    "Workload and Slot Access": ("hours_worked", "all_shifts", "shifts_done", "slot_gap", "total_orders_cpo"),
    "Reliability and Friction": (
        "no_shows",
        "perc_reas",
        "at_customer_time",
        "at_vendor_time",
        "cdt",
        "distance",
    ),
    "Support and Experience": ("contacts", "compliance", "avg_sat_score", "batch", "stacking", "bw_orders"),
    "Momentum and Deterioration": ("wow_delta", "wow_pct_change", "trend_slope_8w"),
    "Context and Seasonality": ("holiday", "season", "city_median"),
}

# Features where a high value lowers the risk.
PROTECTIVE_KEYWORDS = (
    "earnings",
    "total_orders",
    "hours_worked",
    "all_shifts",
    "shifts_done",
    "avg_sat_score",
)

# Owner of an action, first hit wins.
OWNER_KEYWORDS = {
    "Planning": ("slot", "forecast", "capacity", "peak"),
    "Compliance": ("compliance", "violation", "fraud", "fail rate", "appeal"),
    "Rider Support": ("contact", "liveops", "support", "rsat", "retrain"),
    "Finance": ("bonus", "earnings", "payment", "quest", "loyalty"),
    "City Ops": ("distribution", "vendor", "assignment", "distance", "waiting"),
}
DEFAULT_OWNER = "City Ops"

# Topics shared by features and actions, with the text parts that reveal them.
TOPIC_KEYWORDS = {
    "orders": ("orders", "total_orders_cpo", "bw_orders"),
    "earnings": ("earnings", "cpo", "eph", "epd", "epw"),
    "hours": ("hours_worked", "hours"),
    "slot": ("slot", "all_shifts", "shifts_done", "slot_gap"),
    "stack": ("stacking", "batch"),
    "contact": ("contacts", "support", "rsat", "cr"),
    "compliance": ("compliance", "violation", "no_shows", "perc_reas", "fail_rate", "fraud"),
    "distance": ("distance", "sp_distance", "pd_distance", "at_vendor_time", "at_customer_time", "cdt"),
    "weather": ("bw_orders", "bad weather", "rain"),
}

# Bonus for a cheap action.
COST_BONUS = {"low": 0.5, "medium": 0.2}

# Risk driver, recommended action, owner, effort.
DRIVER_PLAYBOOK = (
    (
        "earnings_declining",
        "Review zone/slot assignment — consider priority access to high-demand zones",
        "City Ops",
        "low",
    ),
    (
        "high_waiting_time",
        "Flag top vendors causing wait time; consider courier compensation for excessive waits",
        "Vendor Ops",
        "medium",
    ),
    ("low_slot_availability", "Open additional slots in courier's preferred time windows", "Planning", "low"),
    (
        "high_distance_orders",
        "Review dispatch radius; consider distance-based bonus",
        "Dispatch / City Ops",
        "medium",
    ),
    (
        "compliance_issues",
        "Proactive outreach — clarify violation, offer re-training if applicable",
        "Compliance",
        "medium",
    ),
    ("support_frustration", "Priority support queue; dedicated rider success contact", "Rider Support", "low"),
    ("cash_balance_risk", "Accelerate cash settlement; send balance reminder", "Finance Ops", "low"),
    (
        "declining_engagement",
        "Re-engagement campaign: bonus incentive for next N deliveries",
        "Growth / City Ops",
        "medium",
    ),
    (
        "newbie_struggling",
        "Assign onboarding buddy; offer first-week earnings guarantee",
        "Onboarding",
        "medium",
    ),
    ("no_show_pattern", "Wellness check-in; adjust slot commitments to realistic level", "City Ops", "low"),
)

# Our own choice (the source only says "closest entry"): name parts that point a feature at a driver;
# the first hit wins, and a feature without a hit gets no action.
DRIVER_OF_FEATURE = (
    ("no_shows", "no_show_pattern"),
    ("no_show", "no_show_pattern"),
    ("cash", "cash_balance_risk"),
    ("first_week", "newbie_struggling"),
    ("first_7d", "newbie_struggling"),
    ("first_30d", "newbie_struggling"),
    ("earnings", "earnings_declining"),
    ("cpo", "earnings_declining"),
    ("at_customer_time", "high_waiting_time"),
    ("at_vendor_time", "high_waiting_time"),
    ("waiting", "high_waiting_time"),
    ("cdt", "high_waiting_time"),
    ("distance", "high_distance_orders"),
    ("compliance", "compliance_issues"),
    ("violation", "compliance_issues"),
    ("contact", "support_frustration"),
    ("sat_score", "support_frustration"),
    ("slot_gap", "low_slot_availability"),
    ("slot", "low_slot_availability"),
    ("shifts", "declining_engagement"),
    ("hours", "declining_engagement"),
    ("orders", "declining_engagement"),
)

# Public holidays of the sample market.
HOLIDAYS = (
    (date(2025, 11, 1), "All Saints Day"),
    (date(2025, 11, 11), "Independence Day"),
    (date(2025, 12, 25), "Christmas Day"),
    (date(2025, 12, 26), "Second Day of Christmas"),
    (date(2026, 1, 1), "New Year Day"),
    (date(2026, 1, 6), "Epiphany"),
    (date(2026, 4, 5), "Easter Sunday"),
    (date(2026, 4, 6), "Easter Monday"),
    (date(2026, 5, 1), "Labour Day"),
    (date(2026, 5, 3), "Constitution Day"),
    (date(2026, 5, 24), "Pentecost"),
    (date(2026, 6, 4), "Corpus Christi"),
    (date(2026, 8, 15), "Assumption Day"),
    (date(2026, 11, 1), "All Saints Day"),
    (date(2026, 11, 11), "Independence Day"),
    (date(2026, 12, 25), "Christmas Day"),
    (date(2026, 12, 26), "Second Day of Christmas"),
)

# Columns that would tell a model the outcome, and columns kept out of model input.
LEAKAGE_COLUMNS = ("days_since_last_slot", "week_of_churn", "week_of_churn_feat", "last_order_date")
MODEL_EXCLUDED = ("rider_id", "week_of_churn", "anchor_week", "event_week")

# The 28 weekly measures, the measures with deltas and the per-order numerators.
WEEKLY_METRICS = (
    "batch_number",
    "total_orders_cpo",
    "total_bw_orders",
    "total_earnings",
    "cpo_local_currency",
    "net_cpo_lc",
    "perc_stacking",
    "avg_sp_distance_google",
    "avg_pd_distance_google",
    "at_customer_time_in_minutes",
    "at_vendor_time_in_minutes",
    "cdt",
    "perc_reas",
    "no_shows",
    "shifts_done",
    "all_shifts",
    "hours_worked",
    "contacts_total_tickets",
    "avg_sat_score",
    "compliance_total_violations",
    "compliance_distinct_violation_types",
    "earnings_per_hour",
    "city_median_earnings_per_hour",
    "earnings_vs_city_median_abs",
    "earnings_vs_city_median_ratio",
    "slot_gap_mean_days",
    "slot_gap_max_days",
    "holiday_days_in_week",
)
DELTA_METRICS = (
    "batch_number",
    "total_orders_cpo",
    "total_earnings",
    "cpo_local_currency",
    "no_shows",
    "hours_worked",
    "contacts_total_tickets",
    "avg_sat_score",
    "compliance_total_violations",
)
PER_ORDER_METRICS = (
    "total_earnings",
    "total_bw_orders",
    "no_shows",
    "shifts_done",
    "all_shifts",
    "contacts_total_tickets",
    "compliance_total_violations",
)

# Measures that enter the correlation analysis.
CORRELATION_METRICS = (
    "no_shows",
    "shifts_done",
    "all_shifts",
    "hours_worked",
    "perc_no_show",
    "total_orders_cpo",
    "total_bw_orders",
    "total_earnings",
    "cpo_local_currency",
    "net_cpo_lc",
    "perc_stacking",
    "avg_sp_distance_google",
    "avg_pd_distance_google",
    "avg_total_distance_google",
    "at_customer_time_in_minutes",
    "at_vendor_time_in_minutes",
    "cdt",
    "perc_reas",
    "earning_per_hour",
)
CONTACT_TOP_N = 12

# Report settings.
RANKING_K = (100, 250, 500, 1000)
THRESHOLD_QUANTILES = (0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.93, 0.95, 0.97, 0.98, 0.99)
CALIBRATION_BINS = 10


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(text, F.lit(part))
    return hit


def reason_label(code: Column) -> Column:
    """Label of a reason code; unknown codes pass through, a missing code becomes ``unknown``."""
    pairs = [F.lit(x) for kv in REASON_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code, F.lit("unknown"))


def topic_mask(text: Column) -> Column:
    """One bit per topic found in the text."""
    low = F.lower(text)
    mask = F.lit(0)
    for bit, parts in enumerate(TOPIC_KEYWORDS.values()):
        mask = mask + F.when(contains_any(low, parts), F.lit(1 << bit)).otherwise(F.lit(0))
    return mask


def owner_of(text: Column) -> Column:
    low = F.lower(text)
    pick = None
    for owner, parts in OWNER_KEYWORDS.items():
        hit = contains_any(low, parts)
        pick = F.when(hit, F.lit(owner)) if pick is None else pick.when(hit, F.lit(owner))
    return pick.otherwise(F.lit(DEFAULT_OWNER))


def has_part(name: str, parts: tuple[str, ...]) -> bool:
    low = name.lower()
    return any(p in low for p in parts)
