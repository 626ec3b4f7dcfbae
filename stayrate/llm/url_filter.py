"""URL filters by hashed host-suffix and path-prefix expressions.

Every url is expanded into the expressions that a rule could be written as: the last k labels of its
host joined with the first n characters of its path. Only the label counts and path lengths that occur
among the rules are expanded. Expressions meet rules on a short hash prefix; the full digest confirms
the hit, and precedence picks one rule.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule. An
empty host or path is ordinary otherwise. Repeated urls are judged once and give a row each. Rules with
a null host, path or action are ignored; of equal rules with both actions, ``block`` wins. An empty table gives
an empty result. Of the input only the id and url columns are read, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import UPPER

#: Limits of a rule: labels in a domain name, characters of a path. They bound what the driver learns about the rules.
MAX_LABELS = 127
MAX_PATH = 2048
#: Hex digits of the hash prefix that the join runs on.
PREFIX_DIGITS = 8

_PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    return F.translate(raw, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) with digest, hash prefix and precedence."""
    text = F.concat("host", "path")
    return (
        rules.select(F.translate("host", UPPER, UPPER.lower()).alias("host"), "path", "action")
        .where("host is not null and host != '' and path is not null and action is not null")
        .distinct()
        .select(
            text.alias("rule"),
            "action",
            _labels(F.col("host")).alias("labels"),
            F.length("path").alias("path_length"),
            _digest(text).alias("digest"),
            F.substring(_digest(text), 1, PREFIX_DIGITS).alias("prefix"),
            F.struct(
                F.length(text).alias("length"), F.length("host").alias("host_length"), (F.col("action") == "block").alias("block")
            ).alias("precedence"),
        )
    )


def shapes(table: DataFrame) -> tuple[list[int], list[int]]:
    """The label counts and the path lengths among the rules, at most MAX_LABELS and MAX_PATH + 1 numbers."""
    over = table.where((F.col("labels") > MAX_LABELS) | (F.col("path_length") > MAX_PATH)).select("rule").first()
    if over:
        raise ValueError(f"a rule has more than {MAX_LABELS} labels or {MAX_PATH} characters of path: {over['rule'][:200]}")
    row = table.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    return sorted(row["labels"]), sorted(row["lengths"])


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All expressions of a url that a rule of these shapes could equal."""
    n, size = _labels(host), F.length(path)
    suffixes = F.array_compact(
        F.array(*[F.when((n >= k) & (host != ""), F.substring_index(host, ".", -k)) for k in labels])
    )
    prefixes = F.array_compact(F.array(*[F.when(size >= m, F.substring(path, 1, m)) for m in lengths]))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, the rule that decides (or null) and the verdict.

    ``default`` is the verdict for urls that no rule fits. Urls are judged once per (host, path).
    """
    listed = rule_table(rules)
    labels, lengths = shapes(listed)
    urls = pages.select(
        F.col(id_col), host_of(F.col(url_col).cast("string")).alias("host"), path_of(F.col(url_col).cast("string")).alias("path")
    )
    if not labels:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hits = (
        urls.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels, lengths)).alias("expression"))
        .select("host", "path", _digest(F.col("expression")).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
        .alias("u")
        .join(listed.alias("r"), F.col("u.prefix") == F.col("r.prefix"))
        .where(F.col("u.digest") == F.col("r.digest"))
        .groupBy("u.host", "u.path")
        .agg(F.max(F.struct("r.precedence", "r.rule", "r.action")).alias("best"))
    )
    return (
        urls.alias("p")
        .join(hits.alias("h"), (F.col("p.host") == F.col("h.host")) & (F.col("p.path") == F.col("h.path")), "left")
        .select(
            F.col(f"p.{id_col}"),
            "p.host",
            "p.path",
            F.col("h.best.rule").alias("rule"),
            F.coalesce("h.best.action", F.lit(default)).alias("verdict"),
        )
    )
