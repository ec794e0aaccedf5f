"""op9: documents packed into sequences of at most 1024 ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sufloom.llm.packing import pack

NAME = "op9_packing"
TOKENIZER = "byte_bpe_50k.json"


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(docs, public_tokenizers.path(TOKENIZER), end_id=0, capacity=1024)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
