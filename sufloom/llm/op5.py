"""op5: quality of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sufloom.llm.quality import classify

NAME = "op5_quality_classifier"


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels.select("doc_id", F.col("quality").alias("label")), held_out())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
