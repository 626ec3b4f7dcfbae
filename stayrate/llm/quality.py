"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; policies are versioned masks over those bits, so a change of policy, or an ablation of one rule,
reads the ledger and not the texts.

Defined cases: a null or empty text has no words and all measurements zero, so it fails ``few_words``.
Repeated rows are measured one by one. Whole texts are measured at any length; the work is linear in
the text, but for sorting the word windows of a text in which some window repeats. Of the input only
the id and text columns are read (``reject`` keeps all columns), so other columns never clash. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import SPACE, let, text_or_empty, words

WINDOW = 5
#: Lines from which repeated lines are judged by their characters, and words from which digits are judged: a repeated
#: header among three lines, or a phone number in one sentence, says nothing about a text.
LEAST_LINES = 5
LEAST_WORDS = 50

#: Rules in bit order: name and SQL condition for failure over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("shouting", "2 * n_capitals > n_letters"),
    ("exclamations", "5 * n_exclamations > n_words"),
    ("digits", "4 * n_digits > word_chars"),
    ("duplicate_text", f"n_lines >= {LEAST_LINES} and 10 * dup_line_chars > 3 * line_chars"),
    ("many_digits", f"n_words >= {LEAST_WORDS} and 4 * n_digits > word_chars"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(BITS[n] for n in names)


_V2 = (
    "few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "few_letters", "shouting",
    "exclamations", "digits",
)
#: Versioned policies: the bits that reject a document. v3 weighs repeated lines by their characters, and digits only in longer texts.
POLICIES: dict[str, int] = {
    "v1": mask_of("few_words", "repeated_words"),
    "v2": mask_of(*_V2),
    "v3": mask_of(*[n for n in _V2 if n not in ("duplicate_lines", "digits")], "duplicate_text", "many_digits"),
}
BASE = POLICIES["v1"]
CURRENT = "v3"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals",
    "n_exclamations", "n_digits",
)
#: Characters in all lines, and in lines that repeat an earlier one.
LINE_MEASURES = ("line_chars", "dup_line_chars")


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _covered(starts: Column) -> Column:
    """How many places the windows with these sorted starts cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct(
        (p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n")
    )
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def _repeated(keys: Column) -> Column:
    """Words in windows whose key occurs twice or more. Sorting brings equal keys together."""
    tagged = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def among(s: Column) -> Column:
        same = lambda e, j: (F.get(s, j - 1)["k"] == e["k"]) | (F.get(s, j + 1)["k"] == e["k"])
        return F.transform(F.filter(s, lambda e, j: F.coalesce(same(e, j), F.lit(False))), lambda e: e["i"])

    return _covered(F.array_sort(let(tagged, among)))


def repeated_words(tokens: Column) -> Column:
    """Number of words inside five-word windows that are found twice or more, the first included."""
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    window = lambda h: F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - WINDOW + 1, F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, WINDOW)]),
    )
    counted = lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(_repeated(k))
    return let(let(hashes, window), counted)


def _measured(docs: DataFrame) -> DataFrame:
    """Adds the measurements to rows with a text column ``__text``."""
    text = F.col("__text")
    tokens = words(text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    word_facts = let(
        tokens, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"))
    )
    chars = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda n, line: n + F.length(line))
    line_facts = let(
        let(lines, lambda x: F.struct(x.alias("all"), F.array_distinct(x).alias("once"))),
        lambda x: F.struct(
            F.size(x["all"]).alias("n_lines"),
            (F.size(x["all"]) - F.size(x["once"])).alias("n_dup_lines"),
            chars(x["all"]).alias("line_chars"),
            (chars(x["all"]) - chars(x["once"])).alias("dup_line_chars"),
        ),
    )
    size = F.length(text)
    facts = docs.select(
        "*",
        word_facts.alias("__w"),
        line_facts.alias("__l"),
        _without(text, SPACE + "+").alias("word_chars"),
        (size - _without(text, r"[#*$%&|<>]+")).alias("n_symbols"),
        (size - _without(text, r"\p{L}+")).alias("n_letters"),
        (size - _without(text, r"\p{Lu}+")).alias("n_capitals"),
        (size - _without(text, "!+")).alias("n_exclamations"),
        (size - _without(text, "[0-9]+")).alias("n_digits"),
    )
    place = {"n_words": "__w.n_words", "n_repeat_words": "__w.n_repeat_words"}
    place |= {m: f"__l.{m}" for m in ("n_lines", "n_dup_lines", *LINE_MEASURES)}
    return facts.select(*docs.columns, *[F.col(place.get(m, m)).cast("bigint").alias(m) for m in (*MEASURES, *LINE_MEASURES)])


def failure_bits() -> Column:
    bits = [F.when(F.expr(condition), F.lit(BITS[name])).otherwise(F.lit(0)) for name, condition in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("bigint")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, all measurements and ``failed``, the bits of the rules that it fails."""
    measured = _measured(docs.select(F.col(id_col), text_or_empty(text_col).alias("__text")))
    return measured.select(F.col(id_col), *MEASURES, *LINE_MEASURES, failure_bits().alias("failed"))


def judged(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def reject(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text_or_empty(text_col).alias("__text"))
    kept = _measured(rows).where(failure_bits().bitwiseAND(F.lit(POLICIES[policy])) == 0)
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per rule of a policy: documents that fail it, that fail it alone, and that stay without it.

    Only the counts per distinct mask (two to the number of rules at most) are looked at.
    """
    mask = POLICIES[policy]
    counts = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BITS.items() if bit & mask])
    rows = counts.select("bits", "n", F.explode(rules).alias("r"))
    own = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bits").bitwiseAND(F.lit(mask).bitwiseXOR(F.col("r.bit")))
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("fail"),
        F.sum(F.when(own & (rest == 0), F.col("n")).otherwise(0)).alias("fail_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
