"""Connected components by alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.ordering import durable


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node links its neighbours (the larger ones, or the smaller ones and itself) to the least node around it."""
    if larger:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = around.join(least, "a")
    if larger:
        pairs = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return pairs.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the least node reachable over edges (a, b), for every node in an edge.

    Every round is written to the shared folder; the rounds end when the edges stay as they are, which
    takes about the logarithm of the longest path. A hot node is a group that is summed per task first.
    """
    now = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if row == mark or row["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = row
        now = durable(_stars(_stars(now, True), False))
