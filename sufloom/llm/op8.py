"""op8: token ids of documents written as Parquet list columns and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sufloom.llm.common import new_path
from sufloom.llm.token_output import token_digests, write_tokens

NAME = "op8_token_id_output"
TOKENIZER = "byte_bpe_50k.json"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path(TOKENIZER), end_id=2)
    return token_digests(spark, path)
