"""The corpus pipeline: reject toxic documents, drop boilerplate lines, keep one of near copies, drop leaks of the benchmark, pack.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a frame; all but the last return the columns of
documents as they are named. Null texts score as empty ones. Rows without words are copies of each other for the near-copy stage, so one
of all rows with null, empty or blank texts goes on, and is packed as an empty document. The last stage returns a row for each packed piece.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import decontaminate, line_dedup, packing, simhash, toxicity
from routeloom.llm.common import discard, named, once, table, unused


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; n_chars, where there is such a column, follows the text."""
    n_lines, n_removed = unused(docs, "n_lines", "n_removed")
    cleaned = line_dedup.dedup_lines(docs, n_lines=n_lines, n_removed=n_removed)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*map(named, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def leak_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_filter),
    ("simhash near-dedup", near_copies),
    ("decontamination", leak_filter),
    ("packing", pack_sequences),
]

#: Models, prints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, once(partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
