"""Distributed order against pandas, with ties and a group that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayrate.functions import ordering


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 4000
    p = np.round(rng.random(n), 2)
    p[: n // 3] = 0.5  # a third of the rows share one score
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"id": np.arange(n), "p": p, "g": g, "v": rng.integers(0, 5, n)})
    # eight range partitions although the frame is small
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield pdf, spark.createDataFrame(pdf).repartition(5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_row_numbers_per_group(frame):
    pdf, df = frame
    got = ordering.number_rows(df, [F.col("p").desc(), F.col("id").asc()], ["g"], "rn", "n").toPandas().sort_values("id")
    want = pdf.sort_values(["g", "p", "id"], ascending=[True, False, True])
    want["rn"] = want.groupby("g").cumcount() + 1
    want["n"] = want.groupby("g")["id"].transform("size")
    want = want.sort_values("id")
    assert got["rn"].tolist() == want["rn"].tolist()
    assert got["n"].tolist() == want["n"].tolist()


def test_row_numbers_with_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, g string")
    got = {r["id"]: r["rn"] for r in ordering.number_rows(df, [F.col("id").asc()], ["g"], "rn").collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_running_totals(frame):
    pdf, df = frame
    got = ordering.running_totals(df, [F.col("p").desc(), F.col("id").asc()], ["v"], ["g"], "_run", "_all").toPandas()
    want = pdf.sort_values(["g", "p", "id"], ascending=[True, False, True])
    want["v_run"] = want.groupby("g")["v"].cumsum()
    want["v_all"] = want.groupby("g")["v"].transform("sum")
    got, want = got.sort_values("id"), want.sort_values("id")
    assert got["v_run"].tolist() == want["v_run"].tolist()
    assert got["v_all"].tolist() == want["v_all"].tolist()


def test_dense_ranks_cross_task_borders(frame):
    pdf, df = frame
    got = ordering.dense_ranks(df, "p", [F.col("id").asc()], "r").toPandas().sort_values("id")
    want = pdf["p"].rank(ascending=False, method="dense").astype(int)
    assert got["r"].tolist() == want.tolist()
    # the shared score really is spread over several tasks
    placed = ordering._placed(df, [F.col("p").desc(), F.col("id").asc()], ())
    assert placed.where(F.col("p") == 0.5).select("__pid").distinct().count() > 1


@pytest.mark.parametrize("qs", [[0.0, 0.1, 0.5, 0.9, 1.0], [0.333, 0.987]])
def test_exact_quantiles(frame, qs):
    pdf, df = frame
    assert ordering.exact_quantiles(df, "p", qs) == pytest.approx(np.quantile(pdf["p"], qs).tolist(), abs=1e-12)


def test_quantiles_of_nothing(spark):
    assert ordering.exact_quantiles(spark.createDataFrame([], "p double"), "p", [0.5]) == []


def test_shared_folder_is_the_configured_one(spark):
    assert ordering.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
