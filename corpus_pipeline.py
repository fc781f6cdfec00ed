"""Corpus pipeline: raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of documents, and any others that docs has,
whatever their names. All take an empty docs to an empty result; repeated rows are rows of their own; very long texts are
judged, compared and packed whole. From a stage on, the session reads in smaller pieces (common.small_reads).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import mixing, packing, quality_rules, ranking, simhash
from weft.llm.common import documents, materialize, small_reads, table
from weft.llm.queries import tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking model predicts to be of quality 1. A null text is judged as an empty one; without labels of
    both kinds all stay."""
    small_reads(spark)
    return ranking.passing(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. The model is op3's: fitted on the raw documents, as docs lacks the junk. Null and
    empty texts fail the base rules and go; without labels of both kinds only the base rules decide."""
    small_reads(spark)
    return quality_rules.passing(docs, quality_rules.fit(documents(spark, sf_dir), table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the group's smallest id, nulls last. Texts without words, null
    ones too, are one group; of rows with equal ids the first read stays."""
    small_reads(spark)
    return simhash.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them. Texts without words, null ones too, stay once where their source is
    taken at all; a null source is a source of its own; equal rows are rounded by themselves."""
    small_reads(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences. A null text is one piece of the end id; a null id is kept."""
    small_reads(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("near duplicates", dedup), ("mixing", mix), ("packing", pack)]

#: Trained models and a reduction tree are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
