"""Weekly delivery economics: sums stay hash aggregations, and a bad-weather order counts once per rider and period."""

from datetime import date

from pyspark.sql import functions as F

from stayrate.operators import activity, weekly
from stayrate.params import Params
from stayrate.plans import build, registry
from stayrate.sources import roles

P = Params(as_of=date(2001, 8, 1), start=date(1995, 1, 1))

DELIVERY = (
    "country_code string, rider_id string, order_id bigint, delivery_id string, global_order_id bigint, zone_name string, report_date date, "
    "delivery_status string, total_stacked_deliveries int, pickup_distance_google_in_meters double, dropoff_distance_google_in_meters double, "
    "auto_transition_dropoff string, at_customer_time_in_seconds double, rider_near_restaurant_at timestamp, at_vendor_time_in_seconds double, "
    "courier_delivery_time_in_seconds double, total_reassignments bigint, total_deliveries bigint"
)
PAYMENT = (
    "country_code string, global_order_id bigint, city_code string, order_final_status string, is_dh_data boolean, order_is_standard boolean, "
    "primary_delivery_count bigint, total_compensation_local_currency double, rain_bonus_cost_local_currency double, snow_bonus_cost_local_currency double"
)


def _delivery(rider, order, delivery, shared, zone, day):
    return ("ALL", rider, order, delivery, shared, zone, day, "completed", 1, 1.0, 2.0, None, 60.0, None, 60.0, 60.0, 0, 1)


def _payment(shared, city, rain):
    return ("ALL", shared, city, "DeliveredStatus", True, True, 1, 10.0, rain, 0.0)


def test_orders_count_once_over_zones_cities_and_shared_ids(spark):
    day, later = date(2001, 3, 6), date(2001, 3, 13)
    deliveries = spark.createDataFrame(
        [
            _delivery("a", 1, "d1", 11, "north", day),
            _delivery("a", 1, "d2", 11, "south", day),  # the same order in another zone
            _delivery("a", 1, None, 12, None, day),  # the same order number under another payment, no id
            _delivery("a", 2, "d4", 13, None, day),
            _delivery("a", 3, "d5", 14, "north", day),  # no bonus
            _delivery("a", 1, "d6", 11, "north", later),
            _delivery("b", 1, "d7", 15, None, day),
        ],
        DELIVERY,
    )
    payments = spark.createDataFrame([_payment(11, "X", 1.0), _payment(12, "Y", 1.0), _payment(13, None, 1.0), _payment(14, "Y", 0.0), _payment(15, None, None)], PAYMENT)
    rows = weekly.weekly_delivery_economics(deliveries, payments, P).orderBy("rider_id", "week").collect()
    got = [(r.rider_id, r.city_code, r.zone_name, r.total_bw_orders, r.total_orders_cpo, r.total_earnings, round(r.perc_stacking, 6)) for r in rows]
    assert got == [("a", "Y", "south", 2, 5, 50.0, 1.0), ("a", "X", "north", 1, 1, 10.0, 1.0), ("b", None, None, 0, 1, 10.0, 1.0)]


def test_sums_are_hash_aggregations_of_two_shuffles(spark, data):
    star = roles.Star(spark, data)
    sums = weekly.weekly_delivery_economics(roles.deliveries(star), roles.payments(star), registry.QUARTER)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert "l_partkey" not in plan  # an id that is only counted is not put together


def test_given_activity_replaces_the_pass_over_orders(spark, data):
    star = roles.Star(spark, data)
    src, p = roles.sources(star), registry.QUARTER
    riders = build.rider_activity(src, p)
    one = activity.activity_snapshot(src.orders_nested, src.slots, p)
    two = activity.activity_snapshot(src.orders_nested, src.slots, p, riders)
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0
    assert "lineitem" not in two._jdf.queryExecution().optimizedPlan().toString()
    eligible = riders.where(F.col("eligible")).select("rider_id")
    known = activity.eligible_entities(src.orders_nested, p)
    assert eligible.exceptAll(known).count() == known.exceptAll(eligible).count() == 0
