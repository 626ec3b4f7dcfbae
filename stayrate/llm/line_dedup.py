"""Removal of lines that many documents share.

Lines are normalised, exploded and hashed; the hashes with enough distinct documents are counted with
partial aggregation, so a line found in a third of all documents is a few rows per task. Only hashes
over the threshold travel back to the documents, one set per document, and the lines that stay are
put together again by position. Texts are shuffled once.

Defined cases: a null or empty text is one empty line. A line's key has ASCII white space stripped at both ends
and A-Z lower-cased; keys shorter than ``min_chars`` never go. Documents are told apart by their id:
rows that repeat an id count as one document, a null id counts as one document, and every row loses its own
lines. Whole texts are read at any length. Other columns are kept by ``drop_lines`` and never clash. An empty table gives
an empty result. Keys are compared by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import SPACE_CHARS, ascii_lower, let, text_or_empty

MIN_DOCS = 10
MIN_CHARS = 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """One hash per line, null where the key is too short to be dropped."""
    return F.transform(
        _lines(ascii_lower(text)),
        lambda x: let(
            F.btrim(x, F.lit(SPACE_CHARS)), lambda k: F.when(F.length(k) >= min_chars, F.xxhash64(k))
        ),
    )


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, hashes): per document the hashes of its lines that at least ``min_docs`` documents hold."""
    own = docs.select(
        F.col(id_col).alias("__id"),
        F.explode(F.array_compact(F.array_distinct(line_hashes(text_or_empty(text_col), min_chars)))).alias("__hash"),
    )
    common = own.distinct().groupBy("__hash").agg(F.count(F.lit(1)).alias("__docs")).where(F.col("__docs") >= min_docs)
    return (
        own.join(common.select("__hash"), "__hash", "left_semi")
        .groupBy("__id")
        .agg(F.collect_set("__hash").alias("__bad"))
    )


def drop_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """The documents with the shared lines taken out of their text; ``counts`` names columns for lines before and dropped."""
    bad = frequent_lines(docs, min_docs, min_chars, id_col, text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    text = F.coalesce(F.col("__row").getField(text_col).cast("string"), F.lit(""))
    joined = rows.join(bad, F.col("__row").getField(id_col).eqNullSafe(F.col("__id")), "left").select("__row", "__bad")

    def kept(pair: Column) -> Column:
        stay = F.filter(
            pair["lines"], lambda x, i: ~F.coalesce(F.array_contains(F.col("__bad"), F.get(pair["hashes"], i)), F.lit(False))
        )
        return F.struct(F.size(pair["lines"]).alias("n"), F.size(stay).alias("stay"), F.array_join(stay, "\n").alias("text"))

    pair = F.struct(_lines(text).alias("lines"), line_hashes(text, min_chars).alias("hashes"))
    whole = F.struct(
        F.size(_lines(text)).alias("n"), F.size(_lines(text)).alias("stay"), F.col("__row").getField(text_col).cast("string").alias("text")
    )
    cut = joined.select("__row", F.when(F.col("__bad").isNull(), whole).otherwise(let(pair, kept)).alias("__cut"))
    columns = [
        (F.col("__cut.text") if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns
    ]
    if counts:
        columns += [
            F.col("__cut.n").cast("bigint").alias(counts[0]),
            (F.col("__cut.n") - F.col("__cut.stay")).cast("bigint").alias(counts[1]),
        ]
    return cut.select(*columns)
