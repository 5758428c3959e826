"""A corpus pipeline: five stages, each by one of the training-data operators.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.

Every stage takes nulls in any column, empty and very long texts, repeated rows
(which stay or go together, but for ``near_dedup``, which leaves one), empty
tables and further columns of any name, which pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import sheltered, staged, table
from gridloom.llm.decontamination import decontaminated
from gridloom.llm.language_id import accepted, eligible, train
from gridloom.llm.line_dedup import deduplicated
from gridloom.llm.mixing import mix
from gridloom.llm.near_texts import near_deduplicated


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of undetermined language or an uncertain one: null and empty texts, and those without a letter, among them."""
    return accepted(docs, train(eligible(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest doc_id (nulls last)."""
    return near_deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out units that repeat an earlier one; drops documents that consist of such units alone, or of white space. Null texts stay; ``n_chars`` follows the text."""
    cut = deduplicated(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))
    return cut.where(F.col("text").isNull() | (F.trim(F.col("text")) != "")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item; null and empty texts hold none."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many of their words it takes, repeats counted: ``size``, ``source_size``, ``target`` and ``taken``, with ``mix_`` before names that the documents have."""
    inner, of = sheltered(docs)
    known = [of(c).alias(c) for c in ("doc_id", "text", "source")]
    mixed = mix(inner.select(*known, *inner.columns), keep=tuple(inner.columns)).where("taken > 0")
    own = ["size", "source_size", "target", "taken"]
    taken = {c.lower() for c in docs.columns}
    names = [next(n for n in ("mix_" * k + c for k in range(len(taken) + 1)) if n not in taken) for c in own]
    return mixed.select(*inner.columns, *own).toDF(*docs.columns, *names)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: Languages, fingerprints and BM25 are beyond SQL; a brute-force version tests the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
