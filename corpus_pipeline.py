"""From raw documents to packed training windows: five stages, each one operator of ``stayrate.llm``.

Each stage reads all that the stage before kept. Stages are written to the folder in
``spark.checkpoint.dir``, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayrate.functions.ordering import durable
from stayrate.llm import line_dedup, mixing, near_dedup, packing, quality
from stayrate.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.reject(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share are taken out of the texts; n_chars stays that of the source text."""
    return line_dedup.drop_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts by the target weights of their sources; a document can come in several passes."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in windows of 4096 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Near duplicates by signatures and windows by token ids are not to be had in SQL; tests hold the stages quality_rules and
#: line_dedup against SQL (op5, op6) and near_dedup against brute force; mixing, packing and the run as a whole are not compared.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
