"""Global order, running totals and exact quantiles without a single-task sort.

A window without a partition key, or with a key that holds a third of the rows, ends in one task.
Here the rows are range-partitioned on (group, order key), so a heavy group is spread over many
tasks. The sorted rows are written once to the shared folder; after that every row has a fixed
place (task number, row number inside the task). Per-task totals are tiny, their prefix sums give
each task its starting value, and adding the position inside the task is exact.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MID = "__mid"
_PID = "__pid"

#: Accuracy of the sketch that brackets a quantile, and the share of a group on either side of it that the bracket takes.
#: The sketch is off by 1 / ``SKETCH`` of the group at most, a tenth of that share.
SKETCH = 1_000
BRACKET = 0.01


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets
    a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="stayrate-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    A lost executor then costs a re-read, not a recomputation with other task borders. The table is
    columnar, so a later step reads only the columns it needs and its size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stayrate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables written by this process. Frames built on them can no longer be read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += int(path.getFileSystem(conf).delete(path, True))
    return done


def _placed(df: DataFrame, order: Sequence[Column], groups: Sequence[str]) -> DataFrame:
    keys = [F.col(g).asc_nulls_first() for g in groups]
    ranged = df.orderBy(*keys, *order).withColumn(_MID, F.monotonically_increasing_id())
    return durable(ranged).withColumn(_PID, F.shiftright(F.col(_MID), 33))


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return cond


def number_rows(
    df: DataFrame, order: Sequence[Column], groups: Sequence[str] = (), name: str = "row_no", total: str | None = None
) -> DataFrame:
    """1-based row number per group in a global order; optionally also the size of the group.

    The order must be total (end with a unique key) for a repeatable result.
    """
    placed = _placed(df, order, groups)
    head = placed.groupBy(_PID, *groups).agg(F.count(F.lit(1)).alias("__n"), F.min(_MID).alias("__lo"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    starts = head.select(
        _PID,
        *groups,
        "__lo",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("__all"),
    )
    joined = placed.alias("r").join(starts.alias("s"), _same("r", "s", [_PID, *groups]))
    cols = [F.col(f"r.{c}") for c in df.columns]
    cols.append((F.col(f"r.{_MID}") - F.col("s.__lo") + F.col("s.__before") + 1).cast("bigint").alias(name))
    if total is not None:
        cols.append(F.col("s.__all").alias(total))
    return joined.select(*cols)


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    values: Sequence[str],
    groups: Sequence[str] = (),
    suffix: str = "_run",
    totals: str | None = None,
) -> DataFrame:
    """Inclusive running sums of ``values`` per group; with ``totals`` also the sum over the group."""
    placed = _placed(df, order, groups)
    head = placed.groupBy(_PID, *groups).agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    part = groups or [F.lit(0)]
    before = Window.partitionBy(*part).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    starts = head.select(
        _PID,
        *groups,
        *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__b_{v}") for v in values],
        *[F.sum(f"__t_{v}").over(whole).alias(f"__all_{v}") for v in values],
    )
    inside = Window.partitionBy(_PID, *groups).orderBy(_MID).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(v).over(inside).alias(f"__l_{v}") for v in values])
    joined = local.alias("r").join(starts.alias("s"), _same("r", "s", [_PID, *groups]))
    cols = [F.col(f"r.{c}") for c in df.columns]
    cols += [(F.col(f"r.__l_{v}") + F.col(f"s.__b_{v}")).alias(f"{v}{suffix}") for v in values]
    if totals is not None:
        cols += [F.col(f"s.__all_{v}").alias(f"{v}{totals}") for v in values]
    return joined.select(*cols)


def dense_ranks(df: DataFrame, score: str, tie: Sequence[Column], name: str = "risk_rank") -> DataFrame:
    """Dense rank of ``score`` (highest first) over the whole frame.

    ``tie`` must name the rows uniquely, so that one score held by many rows is spread over many
    tasks. A score that crosses a task border is counted once.
    """
    placed = _placed(df, [F.col(score).desc(), *tie], ())
    inside = Window.partitionBy(_PID).orderBy(F.col(score).desc())
    local = placed.select("*", F.dense_rank().over(inside).alias("__l"))
    head = local.where(F.col(score).isNotNull()).groupBy(_PID).agg(
        F.max("__l").alias("__d"), F.max(score).alias("__first"), F.min(score).alias("__last")
    )
    by_task = Window.partitionBy(F.lit(0)).orderBy(_PID)
    shared = F.when(F.lag("__last").over(by_task) == F.col("__first"), F.lit(1)).otherwise(F.lit(0))
    starts = head.select(_PID, "__d", shared.alias("__shared")).select(
        _PID,
        (
            F.coalesce(F.sum("__d").over(by_task.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            - F.sum("__shared").over(by_task.rowsBetween(Window.unboundedPreceding, 0))
        ).alias("__before"),
    )
    joined = local.alias("r").join(starts.alias("s"), F.col(f"r.{_PID}") == F.col(f"s.{_PID}"), "left")
    rank = F.when(F.col(f"r.{score}").isNotNull(), F.col("r.__l") + F.col("s.__before")).cast("bigint")
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], rank.alias(name))


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """Linearly interpolated quantiles of a column, exact at any size.

    Only two numbers per probability reach the driver.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__c"))
    cum = running_totals(counts, [F.col(column).asc()], ["__c"])
    size = cum.agg(F.max("__c_run").alias("n")).first()["n"]
    if size is None:
        return []
    spots = [(size - 1) * float(q) for q in probabilities]
    picks = []
    for i, h in enumerate(spots):
        picks.append(F.min(F.when(F.col("__c_run") > math.floor(h), F.col(column))).alias(f"lo{i}"))
        picks.append(F.min(F.when(F.col("__c_run") > math.ceil(h), F.col(column))).alias(f"hi{i}"))
    row = cum.agg(*picks).first()
    out = []
    for i, h in enumerate(spots):
        lo, hi = float(row[f"lo{i}"]), float(row[f"hi{i}"])
        out.append(lo if lo == hi else lo + (hi - lo) * (h - math.floor(h)))
    return out


def group_quantiles(df: DataFrame, groups: Sequence[str], value: str, q: float, name: str, *others: Column) -> DataFrame:
    """Per group the smallest value that at least the share ``q`` of its known values does not exceed, exact at any size.

    ``others`` are further aggregates of the first pass. That pass brackets the quantile with a sketch; the second counts
    what lies below the bracket and each distinct value inside, about two in a hundred rows, so no group has to fit in memory.
    ``df`` is read twice.
    """
    v, share = F.col(value), Fraction(str(q))
    bounds = F.percentile_approx(v, [max(q - BRACKET, 0.0), min(q + BRACKET, 1.0)], SKETCH)
    heads = durable(df.groupBy(*groups).agg(bounds.alias("__b"), F.count(v).alias("__n"), *others))
    edges = heads.select(*groups, F.col("__b")[0].alias("__lo"), F.col("__b")[1].alias("__hi"))
    inside = df.alias("r").join(edges.alias("s"), _same("r", "s", groups)).where(v <= F.col("__hi"))
    # one row per distinct value of the bracket; a null stands for all that is below
    counts = inside.groupBy(*[F.col(f"r.{g}").alias(g) for g in groups], F.when(v >= F.col("__lo"), v).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(*groups).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    above = F.expr(f"__n * {share.denominator - share.numerator}L div {share.denominator}L")
    rank = F.greatest(F.col("__n") - above, F.lit(1))
    ranked = counts.withColumn("__run", F.sum("__c").over(upto))
    met = heads.alias("r").join(ranked.alias("s"), _same("r", "s", groups) & (F.col("__run") >= rank) & (F.col("__run") - F.col("__c") < rank), "left")
    missed = F.raise_error(F.lit("a quantile outside the bracket of its sketch"))
    exact = F.when(F.col("__n") > 0, F.coalesce("__v", missed))
    taken = {*groups, "__b", "__n"}
    return met.select(*[F.col(f"r.{g}") for g in groups], exact.alias(name), *[F.col(f"r.{c}") for c in heads.columns if c not in taken])
