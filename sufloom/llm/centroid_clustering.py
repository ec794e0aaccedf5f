"""Centroid clustering of integer vectors, exact at every step, by a bisector tournament.

A vector x is nearer to centroid b than to centroid a if 2 x.(b - a) > |b|^2 - |a|^2, one side of the plane that bisects
the two. The normals b - a and thresholds |b|^2 - |a|^2 of all pairs a < b are computed once a round, as integers. A
vector then plays k - 1 matches: the winner so far against the next centroid, one inner product and one sign each; zero
leaves the smaller number. Distances are taken to the last winner only.

Vectors are those with `dim` components, none null or non-finite, each turned into floor(scale * x), x as double. The
first centroids are the k vectors with the smallest sha256 of salt and vec_id (lowercase hex), in that order. A round
assigns all vectors and replaces each centroid that has any by the componentwise floor of sum / count. Each round is one
job over the table: a task adds up its vectors and returns k rows, and the driver sums k * dim numbers and keeps k
centroids, so nothing but those outlives a round, and a lost executor's share is computed again from the table.

Inner products run in doubles where the batch's magnitudes prove them exact, else in 64-bit integers. Defined results:
vectors with a component of 2^27 or more after scaling take no part (distances to them need not fit a long); an inertia
beyond a long is null. Repeated rows are vectors each, and among equal hashes the smaller vector comes first; a null vec_id
hashes as an empty one. With fewer than k vectors there are as many centroids as vectors; equal centroids keep the smaller
number, and the other has no vectors and stays. Without vectors there are no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sufloom.llm.common import small_batches

MOST = 1 << 27
WIDE = pa.decimal128(38, 0)


def kept_vectors(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their integer vectors."""
    of_size = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    values = column.filter(of_size).flatten()
    x = values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)  # a null component becomes nan
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * x)
        good = (np.abs(x) < MOST).all(axis=1)
    rows = of_size.to_numpy(zero_copy_only=False).astype(bool)
    rows[np.flatnonzero(rows)[~good]] = False
    return rows, x[good].astype(np.int64)


class Tournament:
    """Nearest centroids of integer vectors; centroids: a list of k lists of integers."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        self.normals = self.centroids[None, :, :] - self.centroids[:, None, :]  # [a, b]: b - a
        squares = (self.centroids**2).sum(axis=1)
        self.thresholds = squares[None, :] - squares[:, None]

    def winners(self, x: np.ndarray) -> np.ndarray:
        best = np.zeros(len(x), np.int64)
        normals = self.normals
        if len(x) and 2.0 * x.shape[1] * float(np.abs(x).max()) * float(np.abs(normals).max()) < 2.0**53:
            x, normals = x.astype(float), normals.astype(float)
        for challenger in range(1, len(self.centroids)):
            side = 2 * np.einsum("ij,ij->i", x, normals[best, challenger]) - self.thresholds[best, challenger]
            best[side > 0] = challenger
        return best

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((x - self.centroids[cluster]) ** 2).sum(axis=1)


def exact_sum(a: np.ndarray) -> int:
    """The sum of non-negative 64-bit integers, whatever its size."""
    return (int((a >> 31).sum()) << 31) + int((a & 0x7FFFFFFF).sum())


def totals(vectors: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> tuple[list[int], list[list[int]], list[int]]:
    """Of each centroid's vectors: how many, the sum of each component, and of the distances."""
    k = len(centroids)

    def run(batches):
        game, counts, sums, far = Tournament(centroids), [0] * k, np.zeros((k, dim), object), [0] * k
        for batch in batches:
            _, x = kept_vectors(batch.column("embedding"), dim, scale)
            cluster = game.winners(x)
            apart = game.distances(x, cluster)
            for c in range(k):
                own = cluster == c
                counts[c] += int(own.sum())
                sums[c] += x[own].sum(axis=0).astype(object)
                far[c] += exact_sum(apart[own])
        # dim further components: the sums of vectors, their number, their distances
        lines = [(c, d, int(v)) for c in range(k) for d, v in enumerate([*sums[c], counts[c], far[c]]) if counts[c]]
        if lines:
            a, b, v = zip(*lines)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array([pc.cast(pa.scalar(str(i)), WIDE) for i in v], WIDE)], names=["cluster", "d", "v"])

    parts = vectors.select("embedding").mapInArrow(run, "cluster int, d int, v decimal(38, 0)")
    found = {(r["cluster"], r["d"]): int(r["v"]) for r in parts.groupBy("cluster", "d").agg(F.sum("v").alias("v")).collect()}  # k * (dim + 2) rows
    return [found.get((c, dim), 0) for c in range(k)], [[found.get((c, d), 0) for d in range(dim)] for c in range(k)], [found.get((c, dim + 1), 0) for c in range(k)]


def first_centroids(vectors: DataFrame, k: int, dim: int, scale: int, salt: str) -> list[list[int]]:
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(F.floor(x.cast("double") * scale)) < MOST) & ~F.isnan(x))
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.where((F.size("embedding") == dim) & finite).orderBy(digest, "embedding").limit(k).select("embedding").collect()  # k rows
    return [[math.floor(scale * x) for x in r["embedding"]] for r in rows]


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (array) of each vector of (vec_id, embedding)."""
    spark = vectors.sparkSession
    vectors = small_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    centroids = first_centroids(vectors, k, dim, scale, salt)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not centroids:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        counts, sums, _ = totals(vectors, centroids, dim, scale)
        centroids = [[s // n for s in own] if n else old for n, own, old in zip(counts, sums, centroids)]
    far = totals(vectors, centroids, dim, scale)[2]

    def run(batches):
        game = Tournament(centroids)
        for batch in batches:
            rows, x = kept_vectors(batch.column("embedding"), dim, scale)
            cluster = game.winners(x)
            ids = batch.column("vec_id").filter(pa.array(rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(game.distances(x, cluster))], names=["vec_id", "cluster", "distance"])

    def long_or_null(v: int):
        return F.lit(v if v < 2**63 else None).cast("long")

    assigned = vectors.mapInArrow(run, "vec_id long, cluster int, distance long")
    own = F.get(F.array(*map(long_or_null, far)), F.col("cluster"))
    centre = F.get(F.array(*(F.array(*(F.lit(x).cast("long") for x in c)) for c in centroids)), F.col("cluster"))
    return assigned.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), long_or_null(sum(far)).alias("inertia"), centre.alias("centroid"))


def centroid_digest(components: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()
