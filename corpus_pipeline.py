"""The corpus pipeline: quality, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder and
hands them to the next. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sufloom.llm import op5, op7
from sufloom.llm.common import cut
from sufloom.llm.near_dedup import keep_one_per_component
from sufloom.llm.op9 import pack_documents
from sufloom.llm.quality import keep_good
from sufloom.llm.secrets import mask_secrets
from sufloom.llm.toxicity import keep_clean


def labels_of(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(column).alias("label"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good."""
    return keep_good(docs, labels_of(spark, sf_dir, "quality"), op5.held_out())


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted as toxic."""
    return keep_clean(docs, labels_of(spark, sf_dir, "toxic"), op7.held_out())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, a similarity of 0.8 or more."""
    return keep_one_per_component(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of at most 1024 ids."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

ORACLE_SQL = None  # trained models, Markov scores and token ids aren't expressible in SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if stage is STAGES[-1][1] else cut(out, f"stage-{name}")
    return docs
