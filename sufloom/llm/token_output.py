"""Token ids of documents as Parquet list columns, in document order, for selective reads.

write_tokens range-partitions the documents by doc_id, the text's hash and the row's place, so that a repeated doc_id is
dealt out too, into shards of at most about SHARD_BYTES of text, sorts each partition, encodes it, and writes one file for each partition ("shard"): doc_id and local_start (ids of the shard before the
document) with delta encoding, ids as a dictionary-encoded list, in row groups and pages of stated size, with the page
indexes that Spark's writer always adds. Readers name columns or doc_id ranges, and the scan skips the other columns, row
groups and pages.

Defined results: a null or empty text has the end id alone. Rows that share a doc_id stay next to each other, in the
order of their texts' hashes, each with its own place. A null doc_id comes first. An empty table gives an empty file and no rows. Other columns
are not written.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sufloom.llm.common import prefix_offsets, slices, small_batches
from sufloom.llm.tokenize import encoder as encoder_of

SHARD_BYTES = 256 << 20  # of text in a shard, where the session's shuffle partitions are fewer
SCHEMA = "doc_id long, shard int, local_start long, n_tokens long, ids array<int>"


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    texts = small_batches(texts_of(docs))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    order = ["doc_id", "tie", "place"]
    tied = texts.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    placed = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches):
        from pyspark import TaskContext

        shard, before, encoder, end = TaskContext.get().partitionId(), 0, encoder_of(tokenizer), array("I", [end_id]).tobytes()
        for part in slices(batches):
            ids = [encoder.encode(t) + end for t in part.column("text").to_pylist()]
            lens = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            ends = np.cumsum(lens)
            values = np.frombuffer(b"".join(ids), dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.full(len(ids), shard, np.int32)), pa.array(before + ends - lens), pa.array(lens), lists],
                names=["doc_id", "shard", "local_start", "n_tokens", "ids"],
            )
            before += int(lens.sum())

    writer = placed.mapInArrow(encode, SCHEMA).write.option("compression", "zstd")
    for key, value in {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#local_start": "false",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
    }.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, local_start, n_tokens and start (ids of all documents before it), without reading any ids."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "shard", "local_start", "n_tokens")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    starts = prefix_offsets(totals, "shard", "total", "before")  # one row a shard: as many as the job has partitions
    return rows.join(F.broadcast(starts), "shard").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def read_ids(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id and ids of the documents from first to last; the range reaches the scan, which skips by row group and page."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select("doc_id", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all from the files."""
    rows = small_batches(spark.read.schema(SCHEMA).parquet(path))

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            raw = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes())
            ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64) * 4
            crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])), np.int64, len(ids))
            counts = pa.array((np.diff(ends) // 4).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("local_start"), counts, pa.array(crc)], names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])

    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    starts = prefix_offsets(totals, "shard", "total", "before")
    out = rows.mapInArrow(digest, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long").join(F.broadcast(starts), "shard")
    return out.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
