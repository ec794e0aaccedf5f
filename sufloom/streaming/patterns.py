"""A stream of patterns joined to the static suffix array: stateless, one equi-join for each length in `lengths`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_stream(patterns: DataFrame, sa: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """pattern_id, pattern, seq_id, pos for each match of the streamed (pattern_id, pattern)."""
    parts = []
    for l in lengths:
        own = patterns.where(F.length("pattern") == l).withColumn("key", F.col("pattern"))
        rows = sa.where(F.length("p") >= l).select("seq_id", "pos", F.substring("p", 1, l).alias("key"))
        parts.append(own.join(rows, "key").select("pattern_id", "pattern", "seq_id", "pos"))
    return reduce(DataFrame.unionByName, parts)


def counts_per_batch(matches: DataFrame, path: str, checkpoint: str):
    """Writes the matches of each micro-batch to path, once each."""
    return matches.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
