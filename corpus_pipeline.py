"""The corpus pipeline: five stages over documents, each written and read again.

Stages decide row by row: rows that repeat a doc_id, or have none, are judged by
their own texts.  Every column of documents, and any other, travels unchanged
but for what a stage says; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.decontaminate import contaminated_documents
from waymark.llm.language import accepted_documents
from waymark.llm.minhash import near_duplicates
from waymark.llm.packing import pack_documents
from waymark.llm.pii import redact
from waymark.plans.staging import Stage


def _numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row, and that column's name, which no column of ``docs`` has."""
    column = "_row"
    while column in docs.columns:
        column += "_"
    return Stage(spark, name).put(docs.withColumn(column, F.monotonically_increasing_id()), "numbered"), column


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no language holds two fifths of the words, go.

    So null, empty and white texts go.  Equal texts share a fate.  Where no row has a lang, all with letters stay.
    """
    return accepted_documents(docs, 0.4)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id.

    Of rows that tie, and of those without doc_id where no other is in the group, one stays.  Null and empty texts are in no group and stay.
    """
    numbered, row = _numbered(spark, docs, "dedup")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), shingle=5, percent=80)
    groups = found.select(F.col("doc_id").alias(row), F.col("component_id").alias(f"{row}c"))
    named = numbered.select(row, F.col("doc_id").cast("long").alias(f"{row}d")).join(groups, row)
    first = named.groupBy(f"{row}c").agg(F.min(F.struct(F.col(f"{row}d").isNull().alias("n"), F.col(f"{row}d").alias("d"), F.col(row).alias("r"))).alias("m"))
    return numbered.join(first.select(F.col("m.r").alias(row)), row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none."""
    numbered, row = _numbered(spark, docs, "benchmark")
    found = contaminated_documents(numbered.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)
    return numbered.join(found.where("contaminated").select(F.col("doc_id").alias(row)), row, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars, where there is one, follows the text; null texts stay null."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of at most 2048 tokens; a null or empty text is one end token."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]
#: SQL expresses neither learned models nor the tokenizer; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage.put(step(spark, docs, sf_dir), name)
    return docs
