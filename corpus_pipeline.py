"""The document pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame that is written and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, lines, packing, simhash, toxicity
from quern.llm.common import read_table, small, stage_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model is learned on the labelled rows of ``documents``."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of like lines stays; documents of repeated lines alone go."""
    return lines.keep_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go: rows are told apart by id and text, so a null id keeps none."""
    key = F.struct("doc_id", F.xxhash64("text").alias("t"))
    found = decontaminate.contamination(docs.select(key.alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(F.xxhash64("doc_id.doc_id").alias("d"), "doc_id.t").distinct()
    hit = small(stage_table(hit, "contaminated"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id").alias("d"), F.xxhash64("text").alias("t"))
    return rows.join(hit, ["d", "t"], "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: No SQL: three stages train a model, draw signatures or tokenize. Tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it kept goes through the shared folder as Parquet."""
    docs = read_table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stage_table(docs, name)
    return docs
