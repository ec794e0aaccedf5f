"""Search of large batches of patterns by merging two sorted sides: the batch and the array.

A task that holds patterns in order finds in each batch of the array's rows, put in order of their characters p where they
aren't yet, the rows that begin with a pattern by two binary searches; patterns outside the batch's first and last p are
passed over, except the few that are beginnings of the first. Neither side is copied for each length that occurs.

Patterns of up to SMALL bytes are broadcast in order, and the array isn't moved. More are dealt to range partitions of the
array: each pattern to those whose range it can meet, found by binary search in the partitions' first p (a row each).
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sufloom.operators import packed
from sufloom.sources.scratch import materialize

SMALL = 8 << 20  # bytes of patterns that are broadcast
ROWS_EACH = 1 << 20  # rows of the array for each range partition
log = logging.getLogger(__name__)


def fixed(column: pa.Array) -> np.ndarray:
    """Strings as fixed-width bytes, in whose order and beginnings UTF-8 strings agree with their characters'."""
    data, ends = packed._ascii(column)
    lens = np.diff(ends)
    width = max(1, int(lens.max(initial=0)))
    out = np.zeros((len(lens), width), np.uint8)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(data)) - np.repeat(ends[:-1], lens)] = data
    return out.view(f"S{width}").ravel()


class Batch:
    """Patterns in order: keys, with the numbers by which the caller knows them."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], numbers[order]
        self.ends = np.array([k + b"\xff" for k in self.keys.tolist()]) if len(keys) else self.keys  # behind all that begins with k
        self.lengths = np.unique(np.char.str_len(self.keys)).tolist() if len(keys) else []

    def meet(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of a pattern, row of p) of rows that begin with a pattern."""
        order = np.argsort(p, kind="stable") if (p[1:] < p[:-1]).any() else np.arange(len(p))
        p = p[order]
        low, high = np.searchsorted(self.keys, p[0]), np.searchsorted(self.keys, p[-1], "right")
        begins = [np.arange(np.searchsorted(self.keys, p[0][:n]), np.searchsorted(self.keys, p[0][:n], "right")) for n in self.lengths if n < len(p[0])]
        asked = np.concatenate([np.arange(low, high), *begins])
        first, last = np.searchsorted(p, self.keys[asked]), np.searchsorted(p, self.ends[asked])
        size = last - first
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        return np.repeat(self.numbers[asked], size), order[rows]


def short_matches(patterns: DataFrame, sa: DataFrame, by: str = "pattern", small: int | None = None) -> DataFrame:
    """pattern_id, pattern, seq_id, r, pos of all rows of sa whose p begins with the patterns' column `by`."""
    own = patterns.where(F.col(by).isNotNull()).select("pattern_id", "pattern", F.col(by).alias("_key"))
    rows = sa.select("seq_id", "r", "pos", "p")
    number, size = own.agg(F.count("*"), F.sum(F.octet_length("_key") + F.octet_length("pattern") + 32)).first()
    log.info("%d patterns, %d bytes", number, size or 0)
    kind = dict(patterns.dtypes)["pattern_id"]
    schema = f"pattern_id {kind}, pattern string, seq_id long, r long, pos long"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def answer(batch, ids, texts, p, rest):
        found, at = batch.meet(p)
        if len(found):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(found)), texts.take(pa.array(found)), *(c.take(pa.array(at)) for c in rest)], names=names)

    if (size or 0) <= (SMALL if small is None else small):
        table = own.toArrow().combine_chunks()  # at most SMALL bytes

        def run(batches):
            if not table.num_rows:
                return
            ids, texts, keys = (table.column(c).chunk(0) for c in ("pattern_id", "pattern", "_key"))
            sorted_ = Batch(fixed(keys), np.arange(table.num_rows))
            for b in batches:
                if b.num_rows:
                    yield from answer(sorted_, ids, texts, fixed(b.column("p")), [b.column(c) for c in ("seq_id", "r", "pos")])

        return rows.mapInArrow(run, schema)
    n = sa.count()
    parts = max(2, int(sa.sparkSession.conf.get("spark.sql.shuffle.partitions")) if n < ROWS_EACH else n // ROWS_EACH)
    placed = materialize(rows.repartitionByRange(parts, "p", "seq_id", "r").withColumn("_part", F.spark_partition_id()), "dealt")
    bounds = placed.groupBy("_part").agg(F.min("p").alias("low"), F.max("p").alias("high")).orderBy("_part").collect()  # a row a partition
    lows, highs = np.array([r["low"].encode() for r in bounds]), np.array([r["high"].encode() for r in bounds])
    numbers = [r["_part"] for r in bounds]

    def deal(batches):
        for b in batches:
            keys = fixed(b.column("_key"))
            first = np.searchsorted(highs, keys)  # the first partition that goes on to the key
            last = np.searchsorted(lows, np.array([k + b"\xff" for k in keys.tolist()])) if len(keys) else first
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("pattern_id", "pattern", "_key")), pa.array([numbers[a:z] for a, z in zip(first, last)], pa.list_(pa.int32()))], names=["pattern_id", "pattern", "_key", "_parts"])

    dealt = own.mapInArrow(deal, f"pattern_id {kind}, pattern string, _key string, _parts array<int>").select("pattern_id", "pattern", "_key", F.explode("_parts").alias("_part"))
    both = placed.withColumn("_kind", F.lit(1)).unionByName(dealt.withColumn("_kind", F.lit(0)), allowMissingColumns=True)

    def merged(batches):
        now, sorted_, ids, texts, held = None, None, None, None, []
        for b in batches:
            part, side = b.column("_part").to_numpy(), b.column("_kind").to_numpy()
            edges = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (side[1:] != side[:-1]))).tolist() + [len(part)] if len(part) else []
            for a, z in zip(edges[:-1], edges[1:]):
                piece = b.slice(a, z - a)
                if part[a] != now:
                    now, sorted_, held = part[a], None, []
                if side[a] == 0:
                    held.append(piece.select(["pattern_id", "pattern", "_key"]))
                    continue
                if sorted_ is None:
                    if not held:
                        continue
                    own_ = pa.Table.from_batches(held).combine_chunks()
                    ids, texts = own_.column("pattern_id").chunk(0), own_.column("pattern").chunk(0)
                    sorted_ = Batch(fixed(own_.column("_key").chunk(0)), np.arange(own_.num_rows))
                yield from answer(sorted_, ids, texts, fixed(piece.column("p")), [piece.column(c) for c in ("seq_id", "r", "pos")])

    return both.repartition(parts, "_part").sortWithinPartitions("_part", "_kind", "p").mapInArrow(merged, schema)


def batch_matches(patterns: DataFrame, sa: DataFrame, texts: DataFrame, indexed: int = 32, small: int | None = None) -> DataFrame:
    """pattern_id, pattern, seq_id, r, pos of every match of patterns of any length; p of sa holds `indexed` characters. Of a
    longer pattern the first `indexed` are found by merging, and the rest is compared with the text's blocks at the hits."""
    longest = patterns.agg(F.max(F.length("pattern"))).first()[0] or 0
    hits = short_matches(patterns.withColumn("_head", F.substring("pattern", 1, indexed)), sa, "_head", small)
    if longest <= indexed:
        return hits
    pieces = materialize(packed.pieces_of(packed.blocks_of(texts.select("seq_id", F.coalesce("text", F.lit("")).alias("text")))), "pieces")
    done = hits.where(F.length("pattern") <= indexed)
    open_ = hits.where(F.length("pattern") > indexed)
    for at in range(indexed, longest, packed.CHUNK):
        found = packed.fetched(open_, pieces, F.col("pos") + at, packed.CHUNK)
        open_ = found.where(F.startswith("found", F.substring("pattern", at + 1, packed.CHUNK))).drop("found")
    return done.unionByName(open_.select(*done.columns))
