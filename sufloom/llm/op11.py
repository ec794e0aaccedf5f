"""op11: token counts of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sufloom.llm.token_counts import count_tokens

NAME = "op11_token_counts"
TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
