"""A training corpus from raw documents: toxicity, near-duplicates, benchmark decontamination, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's result to the
shared folder and reads it again as the next stage's docs, so a lost executor repeats one stage at
most. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dedup, sp_sampling, toxicity
from tidemark.llm.common import Workspace, met_by_sorting

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity(docs, labels, keep=COLUMNS[1:])
    return scored.filter("predicted = 0").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8) one row stays: the first by (doc_id, nulls last, row).

    Rows are told apart by a number of their own, as a doc_id may be null or occur again. Rows without
    words are no duplicates and stay.
    """
    work = Workspace(spark, "single", slim=True)
    # written, so that a row has the same number each time it is read
    rows = work.put(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = near_dedup.near_duplicates(rows, width=5, percent=80, key="row").select(F.col("doc_id").alias("row"), "component_id")
    others = groups.filter("row <> component_id")
    members = others.unionByName(others.select(F.col("component_id").alias("row"), "component_id").distinct())
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    firsts = met_by_sorting(members, rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row")
    gone = met_by_sorting(members.select("row"), firsts, "row", "left_anti")
    return met_by_sorting(rows, gone, "row", "left_anti").select(*COLUMNS)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs.select(*COLUMNS), items)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces (identifiers of a sampled segmentation), n_pieces."""
    encoded = sp_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.withColumn("n_pieces", F.size("pieces").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean_of_toxicity),
    ("near_dedup", one_of_each_group),
    ("decontamination", clean_of_benchmarks),
    ("sentencepiece", in_pieces),
]

#: SQL cannot express the classifier, the sketches or the sampled segmentations.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        made = work.put(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
        docs = made
    return docs
