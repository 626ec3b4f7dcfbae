"""Incremental state over several runs equals the batch result."""

from datetime import datetime

from pyspark.sql import functions as F

from stayrate.params import SLOT_STATES
from stayrate.sources import sinks
from stayrate.streaming import incremental

TICKETS = "timestamp timestamp_ntz, content struct<rider_id:string,contact_reason_code:string,global_entity_id:string,action:string>"


def tickets(spark, rows):
    return spark.createDataFrame([(t, (r, c, "PL", "Create")) for t, r, c in rows], TICKETS)


def test_counts_grow_across_runs(spark):
    folder = sinks.work_folder(spark, "stream-test")
    inbox, state, progress = f"{folder}/in", f"{folder}/state", f"{folder}/progress"
    first = [(datetime(2026, 5, 4, 1), "r1", "15A.1"), (datetime(2026, 5, 10, 23), "r1", "15A.1"), (datetime(2026, 5, 11, 0), "r1", None)]
    second = [(datetime(2026, 5, 12, 1), "r1", None), (datetime(2026, 5, 12, 1), "r2", "zz")]
    keys = ["week", "rider_id", "contact_reason_code"]
    for rows in (first, second):
        tickets(spark, rows).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(TICKETS).parquet(inbox)
        incremental.run_available(incremental.ticket_counts(stream), state, progress)
    got = {(str(r["week"]), r["rider_id"], r["contact_reason_code"]): r["ticket_count"] for r in incremental.current_state(spark, state, keys, "ticket_count").collect()}
    assert got == {
        ("2026-05-04", "r1", "address_change"): 2,
        ("2026-05-11", "r1", "unknown"): 2,
        ("2026-05-11", "r2", "zz"): 1,
    }
    # a ticket that comes long after its week still counts
    tickets(spark, [(datetime(2026, 6, 20), "r3", "zz")]).write.mode("append").parquet(inbox)
    incremental.run_available(incremental.ticket_counts(spark.readStream.schema(TICKETS).parquet(inbox)), state, progress)
    tickets(spark, [(datetime(2026, 5, 4, 2), "r1", "15A.1")]).write.mode("append").parquet(inbox)
    incremental.run_available(incremental.ticket_counts(spark.readStream.schema(TICKETS).parquet(inbox)), state, progress)
    now = incremental.current_state(spark, state, keys, "ticket_count").where((F.col("rider_id") == "r1") & (F.col("contact_reason_code") == "address_change"))
    assert now.first()["ticket_count"] == 3


def test_last_activity(spark):
    folder = sinks.work_folder(spark, "stream-test")
    schema = "rider_id bigint, shift_start_at timestamp_ntz, shift_state string"
    for day in (3, 9, 5):
        spark.createDataFrame([(1, datetime(2026, 5, day), "EVALUATED"), (2, datetime(2026, 5, day), "DELETED")], schema).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        incremental.run_available(incremental.last_activity(stream, SLOT_STATES), f"{folder}/state", f"{folder}/progress")
    got = incremental.current_state(spark, f"{folder}/state", ["rider_id"], "last_slot_date").collect()
    assert [(r["rider_id"], str(r["last_slot_date"])) for r in got] == [("1", "2026-05-09")]
