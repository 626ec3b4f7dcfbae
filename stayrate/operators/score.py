"""Ranking scored riders, explaining them and matching actions to cities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.functions.common import finite, numeric_columns, present, safe_div
from stayrate.functions.ordering import dense_ranks, number_rows
from stayrate.functions.rules import (
    CATEGORY_KEYWORDS,
    COST_BONUS,
    DRIVER_OF_FEATURE,
    DRIVER_PLAYBOOK,
    PROTECTIVE_KEYWORDS,
    TOPIC_KEYWORDS,
    has_part,
    topic_mask,
)

PROB = "churn_probability"
NOT_FEATURES = ("is_churned", PROB, "risk_rank", "tenure_days")
DRIVER_TYPE = "array<struct<feature:string,impact_score:double>>"


def score_and_rank(scored: DataFrame, threshold: float = 0.5, key: str = "rider_id") -> DataFrame:
    """High-risk flag and dense risk rank over all riders."""
    flagged = scored.withColumn("is_high_risk", F.col(PROB) >= F.lit(threshold))
    return dense_ranks(flagged, PROB, [F.col(key).asc()], "risk_rank")


def rank_rows(scored: DataFrame, key: str = "rider_id") -> DataFrame:
    """Position of every rider in the order of falling risk, ties by key."""
    return number_rows(scored, [F.col(PROB).desc(), F.col(key).asc()], name="risk_rank")


def top_fraction(
    scored: DataFrame, group: str = "country_code", share: float = 0.10, key: str = "rider_id"
) -> DataFrame:
    """The riskiest share of each group, at least one rider."""
    placed = number_rows(
        scored, [F.col(PROB).desc(), F.col(key).asc()], [group], name="group_rank", total="group_rows"
    )
    limit = F.greatest(F.lit(1), F.ceil(F.col("group_rows").cast("double") * F.lit(float(share))))
    return placed.withColumn("top_rows", limit.cast("bigint")).where(F.col("group_rank") <= F.col("top_rows"))


def contributions(df: DataFrame, keep: Sequence[str] = ("rider_id",)) -> tuple[DataFrame, list[str]]:
    """Signed population z-scores of every numeric column.

    A constant column and a missing value give 0. Mean and deviation are one row for the whole frame;
    only that row reaches the driver, and it comes back as literals, so no join is needed.
    """
    features = numeric_columns(df, (*NOT_FEATURES, *keep))
    x = {f: finite(f) for f in features}
    stats = df.agg(
        *[F.avg(x[f]).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(x[f]).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    out = []
    for i, f in enumerate(features):
        mean, dev = stats[f"m{i}"], stats[f"s{i}"]
        if not dev:
            out.append(F.lit(0.0).alias(f))
            continue
        sign = -1.0 if has_part(f, PROTECTIVE_KEYWORDS) else 1.0
        z = (x[f] - F.lit(mean)) / F.lit(dev) * F.lit(sign)
        out.append(F.coalesce(z, F.lit(0.0)).alias(f))
    return df.select(*present(df, keep), *out), features


def category_scores(features: Sequence[str], categories: dict[str, tuple[str, ...]] = CATEGORY_KEYWORDS) -> list[Column]:
    """Mean positive contribution per driver family. A feature may belong to several families."""
    out = []
    for name, parts in categories.items():
        cols = [f for f in features if has_part(f, parts)]
        total = F.lit(0.0)
        for c in cols:
            total = total + F.greatest(F.col(c), F.lit(0.0))
        out.append((total / F.lit(float(max(1, len(cols))))).alias(f"cat__{name}"))
    return out


def top_drivers(features: Sequence[str], n: int = 5) -> Column:
    """The n largest positive contributions of the row, ties by name. No shuffle."""
    pairs = F.array(*[F.struct((-F.col(f)).alias("k"), F.lit(f).alias("feature")) for f in features])
    positive = F.filter(pairs, lambda e: e["k"] < 0)
    best = F.slice(F.array_sort(positive), 1, n)
    return F.transform(best, lambda e: F.struct(e["feature"].alias("feature"), (-e["k"]).alias("impact_score")))


def explain(df: DataFrame, keep: Sequence[str] = ("rider_id",), n: int = 5) -> DataFrame:
    """Drivers and family scores per rider."""
    contrib, features = contributions(df, keep)
    return contrib.select(
        *present(contrib, keep),
        top_drivers(features, n).alias("top_feature_contributions"),
        *category_scores(features),
    )


def driver_actions(explained: DataFrame, n: int = 3) -> DataFrame:
    """The first n different playbook entries reached by the drivers of a rider, strongest first."""

    def driver_of(feature: Column) -> Column:
        pick = None
        for part, driver in DRIVER_OF_FEATURE:
            hit = F.contains(F.lower(feature), F.lit(part))
            pick = F.when(hit, F.lit(driver)) if pick is None else pick.when(hit, F.lit(driver))
        return pick

    entries = [
        F.struct(F.lit(a).alias("action"), F.lit(o).alias("owner"), F.lit(e).alias("effort"))
        for _, a, o, e in DRIVER_PLAYBOOK
    ]
    book = F.create_map(*[x for (d, *_), s in zip(DRIVER_PLAYBOOK, entries) for x in (F.lit(d), s)])
    found = F.transform("top_feature_contributions", lambda t: driver_of(t["feature"]))
    names = F.slice(F.array_distinct(F.filter(found, lambda d: d.isNotNull())), 1, n)
    actions = F.transform(
        names,
        lambda d: F.struct(
            d.alias("driver"),
            book[d]["action"].alias("action"),
            book[d]["owner"].alias("owner"),
            book[d]["effort"].alias("effort"),
        ),
    )
    return explained.select("rider_id", actions.alias("recommended_actions"))


def city_summary(predictions: DataFrame, city: str = "city") -> DataFrame:
    risky = F.sum(F.col("is_high_risk").cast("bigint"))
    total = F.count("rider_id")
    return predictions.groupBy(city).agg(
        total.alias("total_couriers"),
        risky.alias("high_risk_count"),
        F.avg(PROB).alias("avg_churn_prob"),
        F.bround(safe_div(risky, total) * 100, 1).alias("high_risk_pct"),
        (total - risky).alias("predicted_fleet_30d"),
    )


def city_signals(rows: DataFrame, keys: Sequence[str], n: int = 5, drivers: str = "top_feature_contributions") -> DataFrame:
    """Sum of the positive impacts per feature and city, the n largest per city.

    Drivers may come as an array or as JSON text; text that is not such an array is skipped.
    """
    if dict(rows.dtypes)[drivers] == "string":
        rows = rows.withColumn(drivers, F.from_json(drivers, DRIVER_TYPE))
    each = rows.select(*keys, F.explode(drivers).alias("d")).select(
        *keys, F.trim("d.feature").alias("feature"), F.col("d.impact_score").alias("impact_score")
    )
    summed = (
        each.where((F.col("feature") != "") & (F.col("impact_score") > 0))
        .groupBy(*keys, "feature")
        .agg(F.sum("impact_score").alias("impact_score"))
    )
    w = Window.partitionBy(*keys).orderBy(F.col("impact_score").desc(), F.col("feature"))
    return summed.withColumn("signal_rank", F.row_number().over(w)).where(F.col("signal_rank") <= n)


def playbook_by_topics(playbook: DataFrame, limit: int = 5) -> DataFrame:
    """For each of the 512 possible topic sets, the best distinct actions.

    Topics are nine bits, so the table has at most 512 rows whatever the number of cities, and a city
    finds its actions with one lookup instead of being paired with every action.
    """
    cost = F.lower(F.trim("estimated_cost"))
    bonus = F.lit(0.0)
    for word, value in COST_BONUS.items():
        bonus = F.when(cost == word, F.lit(value)).otherwise(bonus)
    rows = playbook.where(F.trim("action") != "").select(
        "row_no",
        "impact",
        "metric",
        "reason",
        F.trim("action").alias("action"),
        "estimated_cost",
        "owner",
        topic_mask(F.concat_ws(" ", "impact", "metric", "action")).alias("own"),
        bonus.alias("bonus"),
    )
    # Rows with the same topics and bonus score alike for every city, so only the first `limit` actions
    # of such a class can ever be chosen; this bounds the table whatever the length of the sheet.
    detail = F.struct("action", "impact", "metric", "reason", "estimated_cost", "owner")
    firsts = rows.groupBy("own", "bonus", "action").agg(
        F.min("row_no").alias("row_no"), F.min_by(detail, "row_no").alias("d")
    )
    in_class = Window.partitionBy("own", "bonus").orderBy("row_no")
    useful = firsts.withColumn("nth", F.row_number().over(in_class)).where(F.col("nth") <= limit).drop("nth")
    topic_sets = F.explode(F.sequence(F.lit(0), F.lit((1 << len(TOPIC_KEYWORDS)) - 1)))
    match = F.bit_count(F.col("own").bitwiseAND(F.col("topics"))).cast("double") + F.col("bonus")
    scored = useful.select("*", topic_sets.alias("topics")).withColumn("match_score", match)
    best = (
        scored.groupBy("topics", "action")
        .agg(
            F.min_by(
                F.struct("row_no", F.struct("d.*", "match_score").alias("d")), F.struct(-F.col("match_score"), "row_no")
            ).alias("b")
        )
        .select("topics", "b.row_no", "b.d")
    )
    w = Window.partitionBy("topics").orderBy(F.col("d.match_score").desc(), F.col("row_no"))
    top = best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    return top.groupBy("topics").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "d"))), lambda e: e["d"]).alias("playbook_candidates")
    )


def topics_of(categories: Column, features: Column) -> Column:
    """Topic bits of the leading families and features."""
    return topic_mask(F.concat_ws(" ", categories)).bitwiseOR(topic_mask(F.concat_ws(" ", features)))


def match_playbook(cities: DataFrame, playbook: DataFrame, limit: int = 5) -> DataFrame:
    """Add playbook_candidates to rows with dominant_categories and city_top_feature_signals."""
    book = playbook_by_topics(playbook, limit)
    keyed = cities.withColumn(
        "topics", topics_of(F.col("dominant_categories.category"), F.col("city_top_feature_signals.feature"))
    )
    # at most 512 rows of at most `limit` actions
    return keyed.join(F.broadcast(book), "topics", "left").drop("topics")


def country_cities(
    weekly: DataFrame,
    share: float = 0.10,
    n_cities: int = 3,
    n_categories: int = 3,
    n_features: int = 5,
    n_samples: int = 25,
    newbie_cost: float = 0.0,
    country: str = "country_code",
    city: str = "city_code",
) -> DataFrame:
    """One row per country and leading city: who is in the riskiest share and why.

    ``weekly`` has rider_id, churn_probability, risk_rank, top_feature_contributions and the cat__
    columns. Every list in the result has a fixed length.
    """
    keys = [country, city]
    top = top_fraction(weekly, country, share)
    cats = [c for c in weekly.columns if c.startswith("cat__")]
    segment = F.lower("segment") if "segment" in weekly.columns else F.lit("")
    cities = top.groupBy(*keys).agg(
        F.max("group_rows").alias("total_riders_week"),
        F.max("top_rows").alias("top_decile_riders"),
        F.count(F.lit(1)).alias("riders_in_top_decile"),
        F.avg(PROB).alias("avg_churn_probability"),
        F.sum((segment == "newbie").cast("bigint")).alias("newbie_high_risk_count"),
        *[F.avg(F.col(f"`{c}`")).alias(c) for c in cats],
    )
    by_count = Window.partitionBy(country).orderBy(F.col("riders_in_top_decile").desc(), F.col(city))
    cities = cities.withColumn("city_rank", F.row_number().over(by_count)).where(F.col("city_rank") <= n_cities)
    pairs = F.array(
        *[F.struct((-F.col(f"`{c}`")).alias("k"), F.lit(i).alias("i"), F.lit(c[5:]).alias("category")) for i, c in enumerate(cats)]
    )
    dominant = F.transform(
        F.slice(F.array_sort(pairs), 1, n_categories),
        lambda e: F.struct(e["category"].alias("category"), (-e["k"]).alias("impact_score")),
    )
    # city_rank reduces to at most n_cities rows per country before the row-level inputs are joined
    leading = top.join(cities.select(*keys), keys, "left_semi")
    signals = (
        city_signals(leading, keys, n_features)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("signal_rank", "feature", "impact_score"))).alias("s"))
        .select(
            *keys,
            F.transform(
                "s", lambda e: F.struct(e["feature"].alias("feature"), e["impact_score"].alias("impact_score"))
            ).alias("city_top_feature_signals"),
        )
    )
    shown = present(weekly, ["rider_id", "segment", "tenure_days", PROB, "risk_rank", "top_feature_contributions"])
    in_city = Window.partitionBy(*keys).orderBy("group_rank")
    samples = (
        leading.withColumn("rn", F.row_number().over(in_city))
        .where(F.col("rn") <= n_samples)
        .groupBy(*keys)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", F.struct(*shown).alias("r")))), lambda e: e["r"]).alias("sample_riders"))
    )
    empty = F.from_json(F.lit("[]"), DRIVER_TYPE)
    return (
        cities.withColumn("dominant_categories", dominant)
        .join(signals, keys, "left")
        .join(samples, keys, "left")
        .select(
            *keys,
            "city_rank",
            "total_riders_week",
            "top_decile_riders",
            "riders_in_top_decile",
            safe_div("riders_in_top_decile", "top_decile_riders").alias("share_of_country_top_decile"),
            "avg_churn_probability",
            "dominant_categories",
            F.coalesce("city_top_feature_signals", empty).alias("city_top_feature_signals"),
            "newbie_high_risk_count",
            (F.col("newbie_high_risk_count") * F.lit(float(newbie_cost))).alias("newbie_gac_exposure"),
            "sample_riders",
        )
    )


def country_context(cities: DataFrame, share: float = 0.10, country: str = "country_code", city: str = "city_code") -> DataFrame:
    """One row per country with its leading cities (at most three) as an array."""
    detail = [c for c in cities.columns if c not in (country, "total_riders_week", "top_decile_riders", "city_rank")]
    return cities.groupBy(country).agg(
        F.lit(float(share)).alias("top_decile_pct"),
        F.max("total_riders_week").alias("total_riders_week"),
        F.max("top_decile_riders").alias("top_decile_riders"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("city_rank", F.struct(*detail).alias("c")))), lambda e: e["c"]
        ).alias("top_3_cities"),
    )


def action_payload(
    context: DataFrame,
    run_week: str,
    model_name: str,
    metrics: dict[str, float],
    sent_at: str,
    k_values: Sequence[int],
    country: str = "country_code",
) -> DataFrame:
    """The JSON document per country that a downstream system would be sent."""
    figures = F.struct(*[F.lit(float(v)).alias(k) for k, v in metrics.items()]) if metrics else F.struct()
    body = F.struct(
        F.lit("weekly_rider_churn_actions").alias("event_type"),
        F.lit(sent_at).alias("sent_at_utc"),
        F.col(country).alias("country_code"),
        F.lit(run_week).alias("run_week"),
        F.struct(
            F.lit(model_name).alias("name"),
            figures.alias("metrics"),
            F.struct(
                F.array(*[F.lit(int(k)) for k in k_values]).alias("k_values"),
                "top_decile_pct",
                "top_3_cities",
            ).alias("ranking_snapshot"),
        ).alias("model"),
    )
    return context.select(F.col(country).alias("country_code"), F.to_json(body).alias("payload"))
