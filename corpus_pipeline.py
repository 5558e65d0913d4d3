"""Corpus pipeline: quality, exact copies, near copies, source weights, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
``documents``; the last returns the packed pieces.  ``run`` applies them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, mixing, packing, quality, simhash
from ledgerloom.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the classifier learns from the labelled rows of docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = quality.classify(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__kept")), "left_semi")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.keep_rows(docs).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on five-word shingles, the document with the smallest
    doc_id stays: groups of SimHash first, then what these miss.  Rows that repeat an id are judged by their own texts."""
    groups = cut(simhash.similar_rows(docs, words=5, similarity=0.8))
    kept = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("__kept"), F.col("t").alias("__t")).distinct()
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col("__kept")) & (simhash.text_hash(F.col("text")) == F.col("__t"))
    return docs.select(*COLUMNS).join(kept, mine, "left_semi")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal weights for all sources by Poisson replication; a row appears as often as its count says."""
    return mixing.poisson_mix(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens, one row a piece."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_stage), ("exact_dedup", exact_stage), ("simhash_near_dedup", near_stage),
          ("poisson_mixing", mixing_stage), ("cost_balanced_packing", packing_stage)]
#: Floating-point scores, XXH64 votes and BPE ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
