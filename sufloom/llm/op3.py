"""op3: secrets in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sufloom.llm.secrets import digest_text, scan

NAME = "op3_secret_scan"


def number_of(column: str, kind: int) -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = scan(docs.select("doc_id", "text")).select("scanned.doc_id", "base", "found")
    counts = {f"n_{kind}": number_of("base", k) for k, kind in enumerate(("assign", "access", "hex"))}
    return rows.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(digest_text("base"), 256).alias("base_sha256"), digest_text("found").alias("spans"))
