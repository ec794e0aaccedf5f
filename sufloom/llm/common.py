"""What several operators share: cutting lineage, connected components, samples, what a Python process keeps."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sufloom.sources.scratch import discard, materialize as cut, new_path, partitions_of  # noqa: F401

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame, most: str = "4m") -> DataFrame:
    """df; from here on its session hands at most so many bytes at once to Python, so that long texts don't fill the
    memory of a task's two processes. A session with a setting of its own keeps it."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES) == DEFAULT_BATCH:
        spark.conf.set(BATCH_BYTES, most)
    return df


DEFAULT_BATCH = f"{64 << 20}b"


def semi_join_ids(rows: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows whose key is in ids. ids (8 bytes each) are broadcast only after a count shows at most broadcast_rows of them; else both sides are shuffled."""
    if ids.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    return rows.join(ids, key, "left_semi")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of the undirected edges (a, b), of any orderable type: one row (node, label) per node of an
    edge, label being the smallest node of its component.

    The FastSV scheme: each round takes for every node the least grandparent among its neighbours, hooks the node and
    its parent to it, and shortens paths; rounds grow with the logarithm of the diameter. Each round is written to the
    shared folder. Only a checksum of each round reaches the driver.
    """
    one_way = edges.where(F.col("a") != F.col("b")).select("a", "b")
    both = cut(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parents = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "parents")
    seen = None
    for _ in range(max_rounds):
        old = parents
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("grand"))
        grand = parents.join(up, "label")
        near = both.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("least"))
        offers = grand.join(near, "node").select(
            F.explode(
                F.array(
                    F.struct(F.col("label").alias("node"), F.col("least").alias("label")),
                    F.struct(F.col("node").alias("node"), F.least("least", "grand", "label").alias("label")),
                )
            ).alias("x")
        )
        parents = cut(offers.select("x.node", "x.label").groupBy("node").agg(F.min("label").alias("label")), "parents")
        now = parents.agg(F.bit_xor(F.xxhash64("node", "label")), F.count("*")).first()
        discard(old)
        if now == seen:
            discard(both)
            return parents
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def least_hashed(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n distinct non-null values of key with the least hashes: a sample that doesn't depend on order, partitions or
    how often a value is repeated. Of many values only about 4n, those under a hash bound, reach the sort; where the
    bound, set by an estimate of their number, lets fewer than n through, all do."""
    values, h = rows.where(F.col(key).isNotNull()).select(key), F.xxhash64(key)
    about = values.agg(F.approx_count_distinct(key, 0.05)).first()[0]
    if about > 8 * n:
        some = values.where(h < -(2**63) + int(2**64 * 4 * n / about)).distinct()
        if some.limit(n).count() == n:
            values = some
    return values.distinct().orderBy(h, key).limit(n)


def prefix_offsets(counts: DataFrame, part: str, value: str, out: str) -> DataFrame:
    """Exclusive running sum of value by part; counts has one row per partition of a job, so the one-task window is small."""
    from pyspark.sql import Window

    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long").alias(out))


_HELD: dict = {}


def held(key, make):
    """make(), kept in this Python process until another key is asked for: later tasks find a model and the words it has
    met, and a process that serves many stages holds one model at a time."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


class Remembered(dict):
    """solve(word) of each word asked for. A word met again stays, up to `most` bytes in all by an estimate of what an
    entry takes; most words of a large corpus are met once. Words of more than `longest` characters don't stay."""

    def __init__(self, solve, most: int = 40 << 20, longest: int = 64):
        super().__init__()
        self.solve, self.room, self.longest = solve, most, longest
        self.met = bytearray(1 << 20)

    def __missing__(self, word):
        found = self.solve(word)
        if self.room > 0 and len(word) <= self.longest:
            at = hash(word) & 0xFFFFF
            if self.met[at]:
                self.room -= 170 + len(word) + (len(found) if isinstance(found, bytes) else 0)
                self[word] = found
            self.met[at] = 1
        return found


def slices(batches, rows: int = 1000):
    """The stream's batches in parts of at most `rows` rows, so that few texts are Python objects at once; at the end
    Arrow's unused memory goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def null_as_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


LONGS = T.ArrayType(T.LongType())
