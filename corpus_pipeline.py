"""A pipeline of five operators over a table of documents; run() applies them in order.

Each stage takes what its predecessor kept, as a written table, and all but the last return the columns
of documents:

1. quality: documents that the base rules or the likelihood ratio reject go;
2. near duplicates: one document of each group stays (five-word shingles, similarity 0.8 or more);
3. decontamination: documents with a window that nearly equals a benchmark item go;
4. secrets: found secrets are replaced by marks, and n_chars follows;
5. mixing: each document's words are taken as often as its source's target asks; the last stage's columns
   are those of documents with size, source_size, target and taken (a column of documents with one of these
   names gets an underscore before it).

Nulls in any column, empty and very long texts, repeated rows and empty tables pass as the operators'
docstrings say: a null or empty text fails the first stage's rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brinemark.llm import decontaminate, mixing, near_dedup, quality, secret_scan
from brinemark.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.trusted(table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, carry=docs.columns).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]

#: The likelihood ratio and the groups of near duplicates have no SQL; a brute-force version tests run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
