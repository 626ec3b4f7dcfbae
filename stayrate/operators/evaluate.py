"""Exact evaluation tables for a label and a score.

Ties are handled by working on distinct scores: each carries its number of rows and positives. The
curve is a running sum over those, computed without a single-task sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.common import safe_div
from stayrate.functions.ordering import exact_quantiles, number_rows, running_totals
from stayrate.functions.rules import CALIBRATION_BINS, RANKING_K, THRESHOLD_QUANTILES


def score_counts(df: DataFrame, y: str = "y", p: str = "p", groups: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per distinct score."""
    return df.groupBy(*groups, F.col(p).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("tp")
    )


def score_curve(df: DataFrame, y: str = "y", p: str = "p", groups: Sequence[str] = ()) -> DataFrame:
    """Distinct scores from high to low with cumulative rows and positives and the totals."""
    return running_totals(score_counts(df, y, p, groups), [F.col("p").desc()], ["n", "tp"], groups, "_run", "_all")


def curve_metrics(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (Mann-Whitney), average precision over distinct thresholds and Brier score."""
    pos, rows = F.max("tp_all"), F.max("n_all")
    pairs = pos.cast("double") * (rows - pos).cast("double")
    area = F.sum((F.col("n") - F.col("tp")) * (F.col("tp_run") - F.col("tp") / 2))
    steps = F.sum(F.col("tp") * F.col("tp_run") / F.col("n_run"))
    square = F.sum(F.col("tp") * F.pow(F.col("p") - 1, 2) + (F.col("n") - F.col("tp")) * F.pow(F.col("p"), 2))
    return curve.groupBy(*groups).agg(
        F.sum("n").alias("rows"),
        F.sum("tp").alias("positives"),
        safe_div(F.sum("tp"), F.sum("n")).alias("positive_rate"),
        safe_div(area, pairs).alias("roc_auc"),
        safe_div(steps, pos).alias("avg_precision"),
        safe_div(square, F.sum("n")).alias("brier_score"),
    )


def score_metrics(df: DataFrame, y: str = "y", p: str = "p", groups: Sequence[str] = ()) -> DataFrame:
    return curve_metrics(score_curve(df, y, p, groups), groups)


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return score_metrics(df, y, p).select("roc_auc")


def average_precision(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return score_metrics(df, y, p).select("avg_precision")


def brier(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    gap = F.col(p).cast("double") - F.col(y).cast("double")
    return df.agg(F.avg(gap * gap).alias("brier_score"))


def quantile_edges(df: DataFrame, p: str, bins: int) -> list[float]:
    """Edges of equal-frequency bins, repeated edges dropped."""
    return sorted(set(exact_quantiles(df, p, [i / bins for i in range(bins + 1)])))


def bin_index(p: str, edges: Sequence[float]) -> Column:
    """Bins are closed on the right; the lowest value falls into bin 0."""
    index = F.lit(0)
    for e in edges[1:]:
        index = index + (F.col(p) > F.lit(e)).cast("int")
    return index


def calibration_table(df: DataFrame, y: str = "y", p: str = "p", bins: int = CALIBRATION_BINS) -> DataFrame:
    """Mean score and observed rate per equal-frequency bin."""
    edges = quantile_edges(df, p, bins)
    rows = df.where(F.col(p).isNotNull()).groupBy(bin_index(p, edges).alias("bin"))
    return rows.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(p).alias("mean_predicted"),
        F.avg(F.col(y).cast("double")).alias("observed_rate"),
    ).withColumn("calibration_gap", F.col("mean_predicted") - F.col("observed_rate"))


def expected_calibration_error(df: DataFrame, y: str = "y", p: str = "p", bins: int = CALIBRATION_BINS) -> DataFrame:
    table = calibration_table(df, y, p, bins)
    return table.agg(
        safe_div(F.sum(F.col("count") * F.abs("calibration_gap")), F.sum("count")).alias("ece")
    )


def ranked_top(df: DataFrame, k: int, p: str, key: str) -> DataFrame:
    """The k best rows with their position, ties by key."""
    order = [F.col(p).desc(), F.col(key).asc()]
    return number_rows(df, order, name="rank").where(F.col("rank") <= k)


def ranking_at_k(
    df: DataFrame, ks: Sequence[int] = RANKING_K, y: str = "y", p: str = "p", key: str = "id"
) -> DataFrame:
    """Hits, precision, recall and lift among the k highest scores."""
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos")).first()
    n, pos = whole["n"], whole["pos"] or 0
    cuts = [(int(k), min(max(int(k), 1), n)) for k in ks]
    top = ranked_top(df.select(*dict.fromkeys((key, p, y))), max(c for _, c in cuts), p, key)
    hits = [
        F.coalesce(F.sum(F.when(F.col("rank") <= c, F.col(y).cast("bigint"))), F.lit(0)).alias(f"h{i}")
        for i, (_, c) in enumerate(cuts)
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(k).cast("bigint").alias("k"),
                F.lit(c).cast("bigint").alias("cohort_size"),
                F.col(f"h{i}").alias("true_positives_in_top_k"),
            )
            for i, (k, c) in enumerate(cuts)
        ]
    )
    base = F.lit(pos / n if n else None).cast("double")
    precision = safe_div("true_positives_in_top_k", "cohort_size")
    return (
        top.agg(*hits)
        .select(F.inline(rows))
        .select(
            "k",
            "cohort_size",
            "true_positives_in_top_k",
            precision.alias("precision_at_k"),
            safe_div("true_positives_in_top_k", F.lit(pos)).alias("recall_at_k"),
            safe_div(precision, base).alias("lift_at_k"),
            base.alias("base_positive_rate"),
        )
    )


def precision_at_k(df: DataFrame, k: int = 500, y: str = "y", p: str = "p", key: str = "id") -> DataFrame:
    return ranking_at_k(df, [k], y, p, key).select("k", "precision_at_k")


def fold_metrics(df: DataFrame, y: str, p: str, key: str, fold: str, k: int, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Curve metrics, precision among the k highest scores and calibration error of every fold, all folds in one run."""
    rows = df.select(fold, key, F.col(y).cast("bigint").alias("y"), F.col(p).cast("double").alias("p"))
    ranked = number_rows(rows, [F.col("p").desc(), F.col(key).asc()], [fold], "rank", "n")
    spots = [(F.col("n") - 1) * F.lit(i / bins) for i in range(bins + 1)]
    at = lambda spot: F.max(F.when(F.col("n") - F.col("rank") == spot, F.col("p")))
    edges = [at(F.floor(h)) + (at(F.ceil(h)) - at(F.floor(h))) * F.max(h - F.floor(h)) for h in spots]
    tops = ranked.groupBy(fold).agg(
        F.avg(F.when(F.col("rank") <= k, F.col("y"))).alias("precision_at_k"), F.array_distinct(F.array(*edges)).alias("edges")
    )
    passed = F.filter(F.slice("edges", F.lit(2), F.size("edges")), lambda e: e < F.col("p"))
    binned = rows.join(tops.select(fold, "edges"), fold).groupBy(fold, F.size(passed).alias("bin"))
    gaps = binned.agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg(F.col("y").cast("double"))).alias("gap"))
    ece = gaps.groupBy(fold).agg(safe_div(F.sum(F.col("n") * F.col("gap")), F.sum("n")).alias("ece"))
    whole = score_metrics(rows, "y", "p", [fold])
    return whole.join(tops.drop("edges"), fold).join(ece, fold)


def threshold_capacity(
    df: DataFrame, quantiles: Sequence[float] = THRESHOLD_QUANTILES, y: str = "y", p: str = "p"
) -> DataFrame:
    """Cohort size and precision at score quantiles, highest threshold first."""
    cuts = sorted(set(exact_quantiles(df, p, quantiles)), reverse=True)
    aggs = []
    for i, t in enumerate(cuts):
        chosen = F.col(p) >= F.lit(t)
        aggs.append(F.count_if(chosen).alias(f"n{i}"))
        aggs.append(F.avg(F.when(chosen, F.col(y).cast("double"))).alias(f"r{i}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("score_threshold"),
                F.col(f"n{i}").alias("expected_cohort_size"),
                F.col(f"r{i}").alias("expected_precision"),
            )
            for i, t in enumerate(cuts)
        ]
    )
    return df.agg(*aggs).select(F.inline(rows))


def weekly_backtest(df: DataFrame, y: str = "y", p: str = "p", week: str = "event_week") -> DataFrame:
    """Metrics per event period; AUC needs two classes, average precision needs a positive."""
    known = df.where(F.col(week).isNotNull())
    return score_metrics(known, y, p, [week]).select(
        F.col(week).alias("event_week"), "rows", "positive_rate", "roc_auc", "avg_precision", "brier_score"
    )


def threshold_report(
    df: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p", groups: Sequence[str] = (), min_rows: int = 0
) -> DataFrame:
    """Best-F1 operating point, confusion matrix at ``threshold`` and per-class report.

    Equal F1 values give the lowest score threshold.
    """
    curve = score_curve(df, y, p, groups)
    precision, recall = safe_div("tp_run", "n_run"), safe_div("tp_run", "tp_all")
    f1 = 2 * precision * recall / (precision + recall + F.lit(1e-8))
    points = curve.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1)
    best = points.groupBy(*groups).agg(
        F.max_by(F.struct("p", "precision", "recall", "f1"), F.struct("f1", -F.col("p"))).alias("best")
    )
    cut = F.col("p") >= F.lit(threshold)
    neg = F.col("n") - F.col("tp")
    tally = curve.groupBy(*groups).agg(
        F.sum(F.when(~cut, neg).otherwise(F.lit(0))).alias("tn"),
        F.sum(F.when(cut, neg).otherwise(F.lit(0))).alias("fp"),
        F.sum(F.when(~cut, F.col("tp")).otherwise(F.lit(0))).alias("fn"),
        F.sum(F.when(cut, F.col("tp")).otherwise(F.lit(0))).alias("tp"),
    )
    metrics = curve_metrics(curve, groups)
    keys = list(groups)
    if keys:
        joined = metrics.join(best, keys).join(tally, keys)
    else:
        one = F.lit(1).alias("__one")
        joined = metrics.select("*", one).join(best.select("*", one), "__one").join(tally.select("*", one), "__one")

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(safe_div(a, b), F.lit(0.0))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p1, r1 = ratio(tp, tp + fp), ratio(tp, tp + fn)
    p0, r0 = ratio(tn, tn + fn), ratio(tn, tn + fp)
    f_1, f_0 = ratio(2 * p1 * r1, p1 + r1), ratio(2 * p0 * r0, p0 + r0)
    s0, s1 = tn + fp, tp + fn
    out = joined.where(F.col("rows") >= min_rows)

    def macro(a: Column, b: Column) -> Column:
        return (a + b) / 2

    def weighted(a: Column, b: Column) -> Column:
        return ratio(a * s0 + b * s1, s0 + s1)

    return out.select(
        *keys,
        "rows",
        "roc_auc",
        "avg_precision",
        F.col("best.precision").alias("precision_at_threshold"),
        F.col("best.recall").alias("recall_at_threshold"),
        F.col("best.f1").alias("f1_at_threshold"),
        F.col("best.p").alias("optimal_threshold"),
        "tn",
        "fp",
        "fn",
        "tp",
        p0.alias("precision_0"),
        r0.alias("recall_0"),
        f_0.alias("f1_0"),
        s0.alias("support_0"),
        p1.alias("precision_1"),
        r1.alias("recall_1"),
        f_1.alias("f1_1"),
        s1.alias("support_1"),
        ratio(tp + tn, s0 + s1).alias("accuracy"),
        macro(p0, p1).alias("macro_precision"),
        macro(r0, r1).alias("macro_recall"),
        macro(f_0, f_1).alias("macro_f1"),
        weighted(p0, p1).alias("weighted_precision"),
        weighted(r0, r1).alias("weighted_recall"),
        weighted(f_0, f_1).alias("weighted_f1"),
    )


def segment_report(
    df: DataFrame, segment: str = "segment", threshold: float = 0.5, y: str = "y", p: str = "p", min_rows: int = 10
) -> DataFrame:
    """The report per segment; segments with fewer rows are left out."""
    return threshold_report(df.where(F.col(segment).isNotNull()), threshold, y, p, [segment], min_rows)


def importance_table(importances: DataFrame) -> DataFrame:
    """Features by importance with the cumulative share. One row per model feature."""
    order = [F.col("importance").desc(), F.col("feature").asc()]
    run = running_totals(importances, order, ["importance"], (), "_run", "_all")
    return run.select(
        "feature", "importance", safe_div("importance_run", "importance_all").alias("cumulative_importance")
    )
