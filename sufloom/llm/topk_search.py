"""Exact top-k inner-product search with a pivot-distance index.

Vectors become integers, floor(scale * x). One more component, sqrt(M^2 - |x|^2) with M the greatest norm, and 0 for a
query, turns the largest inner products into the smallest distances: |q - x|^2 = |q|^2 + M^2 - 2 q.x. The index keys each
vector by its nearest pivot and its distance to it; sorted by both, runs of at most `block_rows` vectors of one pivot are
annuli, stored as one row each with their least and greatest distance. Pivots are `pivots` vectors with the least hashes.

Of each annulus the least and greatest distance to every pivot is kept too. By the triangle inequality it can hold a vector
within r of a query q only if it meets [d(q, p) - r, d(q, p) + r] for every pivot p, r being the distance of the k-th score
found so far. Queries are grouped alike into blocks, and rounds raise their k-th scores: first the annulus next to the query
block, then the `nearest` annuli of least bound, then all annuli that any bound leaves, each for the queries of the block
that it can serve and no others. This is exact however far the expansion goes. The bounds of a block's queries and of a
pack of PACK annuli are one numpy expression, from distances to pivots alone. Tasks return at most k vectors for each query
and annulus.

Defined results: vectors that are null, empty, hold null or non-finite components, or differ in length from the valid
one with the least vec_id take no part, nor do rows with a null vec_id. Repeated rows of one vec_id are candidates each;
a query's own vec_id is never its candidate, and a repeated query is answered once, by its first row. Scores are exact
while the squared norms of the integer vectors stay below 2^63. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sufloom.llm.common import cut
from sufloom.llm.embedding_dedup import matrix, valid_vectors

BLOCK = "block long, pivot int, lo double, hi double, n long, lows array<double>, highs array<double>, ids array<long>, parts array<long>"
PACK = 512  # annuli


def lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))


def products(a: np.ndarray, b: np.ndarray, exact_in_double: bool) -> np.ndarray:
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if exact_in_double else a @ b.T


def build_blocks(ints: DataFrame, pivots: np.ndarray, top: int, block_rows: int, augment: bool) -> DataFrame:
    """Rows of BLOCK: the vectors of (vec_id, ints), keyed by nearest pivot and distance, in sorted runs."""
    dim = pivots.shape[1] - 1
    high = top

    def to_pivots(x):
        more = np.sqrt(np.maximum(high - (x * x).sum(axis=1), 0).astype(float)) if augment else np.zeros(len(x))
        full = np.concatenate([x.astype(float), more[:, None]], axis=1)
        return np.sqrt(np.maximum((full**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * full @ pivots.T, 0))

    def key(batches):
        for batch in batches:
            x = matrix(batch.column("ints"))
            apart = to_pivots(x)
            near = apart.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("ints"), pa.array(near.astype(np.int32)), pa.array(apart[np.arange(len(x)), near])], names=["vec_id", "ints", "pivot", "apart"])

    keyed = ints.mapInArrow(key, "vec_id long, ints array<long>, pivot int, apart double")
    parts = max(1, int(ints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["pivot", "apart", "tie", "vec_id"]
    dealt = keyed.withColumn("tie", F.xxhash64("vec_id")).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            pivot = batch.column("pivot").to_numpy()
            edges = sorted({0, batch.num_rows, *(np.flatnonzero(np.diff(pivot)) + 1).tolist()})
            for a, b in zip(edges[:-1], edges[1:]):
                for s in range(a, b, block_rows):
                    part = batch.slice(s, min(block_rows, b - s))
                    apart, x = part.column("apart").to_numpy(), matrix(part.column("ints"))
                    each = to_pivots(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int64()), part.column("pivot").slice(0, 1), pa.array([apart[0]]), pa.array([apart[-1]]), pa.array([len(apart)], pa.int64()),
                         lists(each.min(axis=0)[None, :]), lists(each.max(axis=0)[None, :]), lists(part.column("vec_id").to_numpy()[None, :]), lists(x.reshape(1, -1))],
                        names=["block", "pivot", "lo", "hi", "n", "lows", "highs", "ids", "parts"],
                    )
                    number += 1

    assert dim > 0
    return dealt.select("vec_id", "ints", "pivot", "apart").mapInArrow(run, BLOCK)


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
    """For each query (a row of scores): its k best columns with a score of at least its floor, ties to the smaller id, itself left out."""
    for q, (row, self_id, least) in enumerate(zip(scores, own, floor)):
        some = np.flatnonzero((row >= least) & (ids != self_id))
        if len(some) > k:
            cut_at = np.partition(row[some], len(some) - k)[len(some) - k]
            some = some[row[some] >= cut_at]
        order = np.lexsort((ids[some], -row[some]))[:k]
        yield q, some[order]


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    return valid_vectors(vectors).select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale)))).alias("ints"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, pivots: int = 16, block_rows: int = 1024, query_rows: int = 256, nearest: int = 4, stats: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest integer inner product for each row with is_query (of vec_id).
    stats takes pairs, how many pairs of a query and an annulus there are, and searched, how many the last round searches."""
    ints = integer_vectors(vectors, scale)
    square = F.aggregate("ints", F.lit(0).cast("long"), lambda s, x: s + x * x)
    dim, top = ints.agg(F.min_by(F.size("ints"), "vec_id"), F.max(square)).first()
    spark = vectors.sparkSession
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ints = ints.where(F.size("ints") == dim)
    exact = top < 2**53
    sample = ints.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # the pivots: a stated number of rows
    raw = np.array([r["ints"] for r in sample], float)
    centre = np.concatenate([raw, np.sqrt(np.maximum(top - (raw**2).sum(axis=1), 0))[:, None]], axis=1)

    blocks = cut(build_blocks(ints, centre, top, block_rows, augment=True), "annuli")
    asked = ints.where(is_query).groupBy("vec_id").agg(F.min("ints").alias("ints"))
    asked = cut(build_blocks(asked, centre, top, query_rows, augment=False).select(F.col("block").alias("asked"), "pivot", "lo", "hi", F.col("ids").alias("query_ids"), F.col("parts").alias("query_parts")), "asked")
    annuli = blocks.select("block", "pivot", "lo", "hi")

    gap = F.greatest(F.col("a.lo") - F.col("q.hi"), F.col("q.lo") - F.col("a.hi"), F.lit(0.0))
    home = asked.alias("q").join(annuli.alias("a"), F.col("q.pivot") == F.col("a.pivot")).groupBy("asked").agg(F.min(F.struct(gap.alias("gap"), "block")).alias("x")).select("asked", F.col("x.block").alias("block"))
    stored = blocks.select("block", "ids", "parts")

    def column(batch, name, at):
        return batch.column(name).slice(at, 1).flatten().to_numpy(zero_copy_only=False)

    def raised(batches):
        """The k-th score of each query of a block (asked, query_ids, query_parts) with one annulus at most, none yet: the least long."""
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                q = column(batch, "query_parts", at).reshape(-1, dim)
                floor, own = np.full(len(q), np.iinfo(np.int64).min), column(batch, "query_ids", at)
                ids = column(batch, "ids", at)
                if len(ids):
                    scores = products(q, column(batch, "parts", at).reshape(-1, dim), exact)
                    for i, some in best_of(scores, ids, own, floor, k):
                        if len(some) == k:
                            floor[i] = scores[i, some[-1]]
                rows.append(floor)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("asked"), pa.array(rows, pa.list_(pa.int64()))], names=["asked", "floor"])

    def bounded(batches):
        """asked, block, need (the queries that the annulus can serve), least (of their bounds) for blocks of queries and packs of annuli."""
        for batch in batches:
            for at in range(batch.num_rows):
                apart, floor = column(batch, "apart", at).reshape(-1, len(centre)), column(batch, "floor", at)
                square = column(batch, "square", at).astype(float)
                block = column(batch, "blocks", at)
                low, high = (np.array(batch.column(c)[at].as_py()) for c in ("lows", "highs"))
                known = floor > np.iinfo(np.int64).min
                reach = np.where(known, np.sqrt(np.maximum(square + top - 2.0 * np.where(known, floor, 0), 0)), np.inf) + 1e-6 * (1 + top**0.5)
                bound = np.zeros((len(apart), len(block)))
                for p in range(len(centre)):
                    np.maximum(bound, low[None, :, p] - apart[:, p, None], out=bound)
                    np.maximum(bound, apart[:, p, None] - high[None, :, p], out=bound)
                need = bound <= reach[:, None]
                met = np.flatnonzero(need.any(axis=0))
                if len(met):
                    least = np.where(need, bound, np.inf).min(axis=0)[met]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(met), batch.column("asked")[at].as_py())), pa.array(block[met]), pa.array([np.flatnonzero(need[:, b]).astype(np.int32) for b in met], pa.list_(pa.int32())), pa.array(least)],
                        names=["asked", "block", "need", "least"],
                    )

    def measured(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                q = column(batch, "query_parts", at).reshape(-1, dim)
                x = np.concatenate([q.astype(float), np.zeros((len(q), 1))], axis=1)
                apart = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (centre**2).sum(axis=1)[None, :] - 2 * x @ centre.T, 0))
                yield pa.RecordBatch.from_arrays([batch.column("asked").slice(at, 1), lists(apart.reshape(1, -1)), lists((q * q).sum(axis=1)[None, :])], names=["asked", "apart", "square"])

    number = blocks.count()
    packs = blocks.select(F.pmod(F.xxhash64("block"), F.lit(-(-number // PACK))).alias("pack"), "block", "lows", "highs").groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("block", "lows", "highs"))).alias("x"))
    packs = cut(packs.select("pack", F.col("x.block").alias("blocks"), F.col("x.lows").alias("lows"), F.col("x.highs").alias("highs")), "packs")
    distances = cut(asked.select("asked", "query_parts").mapInArrow(measured, "asked long, apart array<double>, square array<long>"), "distances")

    def left_by(floors):
        each = distances.join(floors, "asked").withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-number // PACK) - 1).cast("long"))))
        return each.join(packs, "pack").select("asked", "apart", "square", "floor", "blocks", "lows", "highs").mapInArrow(bounded, "asked long, block long, need array<int>, least double")

    def best_so_far(pairs):
        """The k-th scores that the annuli of the pairs give, for each query the greatest of them."""
        met = asked.select("asked", "query_ids", "query_parts").join(pairs, "asked", "left").join(stored, "block", "left")
        each = met.select("asked", "query_ids", "query_parts", "ids", "parts").mapInArrow(raised, "asked long, floor array<long>")
        return each.select("asked", F.posexplode("floor").alias("i", "f")).groupBy("asked", "i").agg(F.max("f").alias("f")).groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("i", "f")))["f"].alias("floor"))  # query_rows entries

    floors = cut(best_so_far(home), "floors")
    order = F.row_number().over(Window.partitionBy("asked").orderBy("least", "block"))
    closest = cut(left_by(floors).withColumn("place", order).where(F.col("place") <= nearest).select("asked", "block"), "closest")
    floors = cut(best_so_far(closest.unionByName(home.where("block is not null"))), "floors")
    pairs = cut(left_by(floors).join(floors, "asked").select("asked", "block", "need", "floor"), "pairs")
    if stats is not None:
        stats["pairs"] = number * asked.agg(F.sum(F.size("query_ids"))).first()[0]
        stats["searched"] = pairs.agg(F.sum(F.size("need"))).first()[0] or 0
    work = pairs.join(asked.select("asked", "query_ids", "query_parts"), "asked").join(stored, "block")

    def search(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                need = column(batch, "need", at)
                ids, own, floor = column(batch, "ids", at), column(batch, "query_ids", at)[need], column(batch, "floor", at)[need]
                scores = products(column(batch, "query_parts", at).reshape(-1, dim)[need], column(batch, "parts", at).reshape(-1, dim), exact)
                found = [(np.full(len(some), own[q]), ids[some], scores[q, some]) for q, some in best_of(scores, ids, own, floor, k)]
                a, b, c = (np.concatenate(v).astype(np.int64) for v in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "vec_id", "score"])

    hits = work.select("query_ids", "query_parts", "ids", "parts", "floor", "need").mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
