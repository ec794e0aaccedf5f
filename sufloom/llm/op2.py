"""op2: SentencePiece encoding and decoding of documents: the file's own segmentation (merges), and beside it the path of
greatest total score over the same pieces, found by the max-plus scan.

For a merge model whose words are apart, one pass makes both (sufloom.llm.segments). For others each is made alone: both spell
the same text, so a row's two results meet by doc_id and the checksum of the decoded text; repeated rows have equal
results, and a null doc_id meets a null one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sufloom.llm import merges, pieces, segments
from sufloom.llm.pieces import digests

NAME = "op2_sentencepiece"
MODEL = "piece_bpe_32k.model"


def both(docs: DataFrame, model: str, giant: int = 32_768, chunk: int = 8_192) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_crc32 of each row by the file's own rules; scan_tokens and scan_crc32 by the scan."""
    if merges.is_merges(model) and pieces.pieces_of(model).words_apart:
        return segments.encode(docs, model, giant, chunk, digest=True)
    return joined(docs, model, giant, chunk)


def joined(docs: DataFrame, model: str, giant: int = 32_768, chunk: int = 8_192) -> DataFrame:
    """both(), for any model."""
    own = digests(merges.encode(docs, model, giant, chunk), model)
    scan = digests(pieces.encode(docs, model, giant, chunk), model).select(
        F.col("doc_id").alias("scan_id"), F.col("decoded_crc32").alias("scan_text"), F.col("n_tokens").alias("scan_tokens"), F.col("ids_crc32").alias("scan_crc32")
    )
    same = F.col("doc_id").eqNullSafe(F.col("scan_id")) & (F.col("decoded_crc32") == F.col("scan_text"))
    return own.join(scan.dropDuplicates(["scan_id", "scan_text"]), same, "left").drop("scan_id", "scan_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
