"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, mixing.

Each stage is a function of (spark, docs, sf_dir) on all that its predecessor kept, written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``, with whatever names and values
they came, texts and ``n_chars`` of :func:`line_dedup` apart.

Rows. A null or letterless text goes at the first stage, if anything is labelled there; later stages keep such rows. Rows with
a null ``doc_id`` are never near duplicates; of rows with equal ``doc_id`` and text one stays. Ties go to the smaller
``doc_id``. Empty tables pass through empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accentweave.llm import decontaminate, jaccard, langid, mixing, templates
from accentweave.llm.storage import free_name, stash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not stand by go."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; ``n_chars`` follows. No document goes."""
    names = (free_name(docs, "n_lines"), free_name(docs, "n_dropped"))
    out = templates.dedup_lines(docs, keep_first=True, names=names)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(names[1]) > 0, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]

# Stages 1 to 4 hold a trained model, trees and components: SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = stash(stage(spark, docs, sf_dir), name)
    return docs
