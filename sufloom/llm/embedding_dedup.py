"""Near-duplicate embeddings by spherical-cap filters.

A vector's direction is cut into two halves. For each half there is a random code: the signed columns of random
orthogonal bases. A filter is a pair of code words, one for each half, standing for their joint direction; a vector takes
every filter whose inner product with it exceeds `cap`, listed from the two sorted lists of half products without trying
all pairs (list decoding). Vectors are joined on filters: each filter's vectors, in blocks of at most `block_rows`, are
compared in tasks by their double-precision cosines. A pair counts in the first filter its vectors share only. Tasks
return counts of links and a spanning forest of each block's links, never the pairs. Equal vectors are compared as one.

Two vectors with cosine c share a filter with a probability that grows with c and falls with cap; tests measure the
recall against brute force.

Defined results: null vectors, zero vectors, vectors with a null or non-finite component or of another length than the
first valid one by vec_id order take no part: n_links 0, their own component. Repeated rows count as vectors of their
own; the rows of one vec_id share their component. Rows with a null vec_id come back without links. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sufloom.llm.common import components, cut


def half_codes(dim: int, words: int, seed: int) -> np.ndarray:
    """words unit vectors of dim components: the signed rows of random orthogonal bases."""
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    while len(out) * 2 * dim < words:
        basis = np.zeros((dim, dim))
        for i, v in enumerate(rng.standard_normal((dim, dim))):
            v = v - (basis[:i] * (basis[:i] * v).sum(axis=1)[:, None]).sum(axis=0)
            basis[i] = v / np.sqrt((v * v).sum())
        out.append(np.concatenate([basis, -basis]))
    return np.concatenate(out)[:words]


def decode(units: np.ndarray, left: np.ndarray, right: np.ndarray, cap: float, least: int = 16) -> list[np.ndarray]:
    """For each unit vector the sorted ids of all filters (i * len(right) + j) with (<x1, left_i> + <x2, right_j>) / sqrt(2) >= cap;
    of a vector with fewer than `least` such filters, the nearest `least`."""
    half = left.shape[1]
    # einsum, whose sums don't depend on how many vectors come at once: a vector always lists the same filters
    p, q = np.einsum("ij,kj->ik", units[:, :half], left), np.einsum("ij,kj->ik", units[:, half:], right)
    need = cap * np.sqrt(2)
    order = np.argsort(-q, axis=1)
    out = []
    for row in range(len(units)):
        o = order[row]
        ranked = q[row][o]
        usable = np.flatnonzero(p[row] + ranked[0] >= need)
        takes = np.searchsorted(-ranked, -(need - p[row][usable]), side="right")
        if takes.sum() < least:
            i, j = np.argsort(-p[row])[:least], o[:least]
            flat = np.argsort(-(p[row][i][:, None] + q[row][j][None, :]), axis=None)[:least]
            out.append(np.sort(i[flat // len(j)] * len(right) + j[flat % len(j)]))
        else:
            out.append(np.sort(np.concatenate([i * len(right) + o[:t] for i, t in zip(usable, takes)])))
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Indices of pairs that span the components of the graph of pairs (a, b) on n nodes."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
            kept.append(k)
    return kept


def grouped_by_key(batches, columns: tuple[str, ...]):
    """The stream's groups of equal, adjacent keys as tables."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        if not table.num_rows:
            continue
        mark = np.zeros(table.num_rows, bool)
        for c in columns:
            v = table[c].to_numpy()
            mark[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(mark).tolist()]
        for s, e in zip(starts[:-1], starts[1:]):
            yield table.slice(s, e - s)
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def valid_vectors(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part; zero vectors stay in."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, cap: float | None = None, words: int | None = None, block_rows: int = 512, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. See the module."""
    spark = vectors.sparkSession
    # Single-precision vectors travel as such; all products are of doubles.
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(usable & F.col("vec_id").isNotNull(), F.lit(False))
    first = every.where(usable).agg(F.min_by(F.size("embedding"), "vec_id"), F.count("*")).first()
    dim, rows = first[0] or 0, first[1]
    fine = usable & (F.coalesce(F.size("embedding"), F.lit(0)) == dim)
    alone = every.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not rows:
        return alone.withColumn("kept", F.lit(True))
    # More words as the table grows: the filters' mean load stays the same.
    words = words or int(min(4096, max(64, 2 ** math.ceil(math.log2(max(1.0, rows / 8)) / 2))))
    size = dim + dim % 2
    left, right = half_codes(size // 2, words, seed), half_codes(size // 2, words, seed + 1)
    cap = cap if cap is not None else cap_for(left, right, size, load=48.0 * max(1.0, words / 128) ** 0.5)

    def units_of(column) -> np.ndarray:
        x = matrix(column).astype(float)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def filters_of(units: np.ndarray) -> list[np.ndarray]:
        return decode(np.pad(units, ((0, 0), (0, size - dim))), left, right, cap)

    def filters(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                mine = filters_of(units_of(part.column("embedding")))
                lens = np.array([len(f) for f in mine], np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(np.concatenate(mine).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "vec_id", "copies", "embedding")), listed], names=["row", "vec_id", "copies", "embedding", "filters"])

    # Equal vectors are one class, compared once; row numbers the classes.
    classes = every.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = classes.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "copies", "embedding")
    coded = cut(classes.mapInArrow(filters, f"row long, vec_id long, copies long, embedding array<{kind}>, filters array<long>"), "coded")

    placed = coded.select("row", F.explode("filters").alias("filter"))
    loads = placed.groupBy("filter").agg(F.count("*").alias("n")).where("n > 1")
    placed = placed.join(loads, "filter").withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("row", "filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.join(coded.select("row", "vec_id", "copies", "embedding"), "row").repartition(parts, "filter", "i", "j").sortWithinPartitions("filter", "i", "j")

    def compare(batches):
        for block in grouped_by_key(batches, ("filter", "i", "j")):
            i, j, f = block["i"][0].as_py(), block["j"][0].as_py(), block["filter"][0].as_py()
            own = block["own"].to_numpy()
            mine, theirs = (np.arange(len(own)),) * 2 if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
            if not len(mine) or not len(theirs):
                continue
            units = units_of(block["embedding"])
            hit = units[mine] @ units[theirs].T >= threshold
            if i == j:
                hit &= mine[:, None] < theirs[None, :]
            p, q = np.nonzero(hit)
            if not len(p):
                continue
            p, q = mine[p], theirs[q]
            met = np.unique(np.concatenate([p, q]))  # only vectors with a link here list their filters again
            again = [x[x < f] for x in filters_of(units[met])]
            known, code = np.unique(np.concatenate(again), return_inverse=True)
            held = np.zeros((len(met), len(known) or 1), np.float32)
            held[np.repeat(np.arange(len(met)), [len(x) for x in again]), code] = 1
            earlier = (held @ held.T) > 0  # a filter before this one holds both
            new = ~earlier[np.searchsorted(met, p), np.searchsorted(met, q)]
            p, q = p[new], q[new]
            if not len(p):
                continue
            copies, row, ids = (block[c].to_numpy() for c in ("copies", "row", "vec_id"))
            counts = np.bincount(np.concatenate([p, q]), weights=np.concatenate([copies[q], copies[p]]), minlength=len(own)).astype(np.int64)
            some, tree = np.flatnonzero(counts), forest(p, q, len(own))
            columns = [
                np.concatenate([row[some], np.full(len(tree), -1)]),
                np.concatenate([ids[some], ids[p[tree]]]),
                np.concatenate([ids[some], ids[q[tree]]]),
                np.concatenate([counts[some], np.zeros(len(tree), np.int64)]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "a", "b", "n"])

    found = cut(dealt.mapInArrow(compare, "row long, a long, b long, n long"), "found")
    links = found.where("row >= 0").groupBy("row").agg(F.sum("n").alias("n"))
    by_class = coded.join(links, "row", "left").select("embedding", F.col("vec_id").alias("least"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = cut(every.where(fine).join(by_class, "embedding").select("vec_id", "least", "n_links"), "linked")
    edges = found.where("row < 0").select("a", "b").unionByName(own.select(F.col("vec_id").alias("a"), F.col("least").alias("b"))).where("a <> b").distinct()
    joined = components(edges).select(F.col("node").alias("vec_id"), F.col("label").alias("component_id"))
    per_row = own.join(joined, "vec_id", "left").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    return per_row.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def cap_for(left: np.ndarray, right: np.ndarray, size: int, load: float, samples: int = 500) -> float:
    """The cap at which a random direction takes `load` filters on average, from a fixed sample of directions."""
    x = np.random.default_rng(0).standard_normal((samples, size))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    p, q = np.einsum("ij,kj->ik", x[:, : size // 2], left), np.einsum("ij,kj->ik", x[:, size // 2 :], right)
    every = np.partition((p[:, :, None] + q[:, None, :]).reshape(samples, -1) / np.sqrt(2), -max(1, int(load)), axis=1) if len(left) * len(right) <= 1 << 16 else None
    if every is not None:
        return float(np.median(every[:, -max(1, int(load))]))
    caps = []
    for a, b in zip(p, q):
        a, b = np.sort(a)[::-1][:256], np.sort(b)[::-1][:256]
        s = np.sort((a[:, None] + b[None, :]).ravel())[::-1] / np.sqrt(2)
        caps.append(s[min(int(load), len(s)) - 1])
    return float(np.median(caps))
