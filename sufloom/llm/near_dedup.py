"""Near-duplicate documents by MinHash bands, odd sketches and full shingle sets.

A document's set holds its distinct word shingles. Two documents are linked if 100 * |intersection| >=
similarity * |union|. The steps, all Spark jobs:

1. One pass over the texts gives each document a fingerprint of its set, `bands` band keys of `rows` MinHash values each,
   and an odd sketch: the MinHash values folded into a parity bitmap. XOR of two sketches has a population count that
   estimates the size of the symmetric difference of the MinHash samples.
2. Equal sets form a class, so copies are never paired; from here on a class is one node.
3. In each band bucket all nodes are compared with the bucket's smallest node (linear in the bucket): sketches first,
   then full sets. Links found here give first components.
4. Buckets whose other members still lie in different components are compared in blocks of `block_rows` nodes, in tasks;
   a pair is looked at only in the first bucket it shares, and leaves the task only if its sketches are close and its
   components differ. Full sets confirm it.

Documents with similarity s share no bucket with probability (1 - s^rows)^bands, 3e-6 at s = 0.8 with the defaults;
the sketch cut lies five standard deviations below the threshold. Sets hold 64-bit hashes of shingles, the fingerprint 128 bits.

Defined results: a null or empty text, or one of white space alone, has an empty set, linked with nothing (its own
component). Repeated rows with one doc_id come back as often as they came, each with its own set; a component's id is
the smallest doc_id in it. A row with a null doc_id is kept; it takes part through documents with an equal set only. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sufloom.llm.common import components, cut, discard, partitions_of, semi_join_ids, slices, small_batches
from sufloom.llm.wordhash import mix, shingle_sets

SKETCH_WORDS = 16  # 1024 bits
FINE_SAMPLES, FINE_WORDS = 2048, 128  # of the sketches that bucket blocks are compared by


def minhash(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """MinHash values (a row per non-empty set) under `samples` multiply-add hash functions."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    factors, shifts = mix(np.arange(samples, dtype=np.uint64), 1) | np.uint64(1), mix(np.arange(samples, dtype=np.uint64), 2)
    out = np.empty((len(sets), samples), np.uint64)
    room = np.empty(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(samples):
            np.multiply(flat, factors[j], out=room)
            room += shifts[j]
            room >>= np.uint64(16)
            out[:, j] = np.minimum.reduceat(room, starts)
    return out


def odd_sketch(values: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parity bitmap of each row's (sample number, MinHash value) pairs, as rows of 64-bit words."""
    rows, samples = values.shape
    bits = words * 64
    with np.errstate(over="ignore"):
        at = mix(values + np.arange(samples, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), 3) % np.uint64(bits)
    flat = (at.astype(np.int64) + np.arange(rows, dtype=np.int64)[:, None] * bits).ravel()
    odd = (np.bincount(flat, minlength=rows * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, bits), axis=1).view(np.uint64)


def sketch_cut(similarity: float, samples: int, words: int = SKETCH_WORDS, sigmas: float = 5.0) -> int:
    """Largest population count of two sketches' XOR at which a pair may still reach the similarity: so many standard
    deviations of the MinHash sample and of the parity bitmap below it."""
    bits, apart = words * 64, 2 * samples * (1 - similarity)
    decay = math.exp(-2 * apart / bits)
    parity = max(bits / 4 * (1 - decay**2) - apart * decay**2, 0) / (decay * 2 * samples) ** 2
    low = similarity - sigmas * math.sqrt(similarity * (1 - similarity) / samples + parity)
    return math.ceil(bits / 2 * (1 - math.exp(-2 * (2 * samples * (1 - max(low, 0.0))) / bits)))


def signatures(docs: DataFrame, width: int = 2, bands: int = 32, rows: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, fingerprint (h1, h2), bands (band keys) and sketch; the last two are null for an empty set."""

    def run(batches):
        for batch in slices(batches, 2000):
            texts = batch.column("text").to_pylist()
            sets = list(shingle_sets(texts, width))
            lens = np.fromiter((len(s) for s in sets), np.int64, len(sets))
            h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            keys, sketches = np.zeros((len(sets), bands), np.int64), np.zeros((len(sets), SKETCH_WORDS), np.int64)
            full = np.flatnonzero(lens)
            size = np.cumsum(lens[full])
            for part in np.split(full, np.searchsorted(size, np.arange(1_000_000, size[-1], 1_000_000))) if len(full) else []:
                if not len(part):
                    continue
                own = [sets[i] for i in part]
                flat, starts = np.concatenate(own), np.concatenate([[0], np.cumsum([len(s) for s in own])[:-1]])
                with np.errstate(over="ignore"):
                    h1[part], h2[part] = np.add.reduceat(mix(flat, 4), starts), np.add.reduceat(mix(flat, 5), starts)
                    values = minhash(own, bands * rows)
                    k = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(own), bands)).copy()
                    for r in range(rows):
                        k = mix(k + values.reshape(len(own), bands, rows)[:, :, r], 6)
                keys[part], sketches[part] = k.view(np.int64), odd_sketch(values).view(np.int64)
            none = lens == 0

            def lists(a):
                return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()), mask=pa.array(none))

            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lens), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists(keys), lists(sketches)],
                names=["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"],
            )

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, width: int = 2) -> DataFrame:
    """node (doc_id and half the fingerprint) and the set's hashes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = list(shingle_sets(part.column("text").to_pylist(), width))
                lens = np.array([len(s) for s in sets], np.int64)
                with np.errstate(over="ignore"):
                    h1 = pa.array(np.array([int(mix(s, 4).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64))
                hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array((np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), h1, hashes], names=["doc_id", "h1", "hashes"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, h1 long, hashes array<long>")
    return out.select(F.struct("doc_id", "h1").alias("node"), "hashes").dropDuplicates(["node"])


def fine_sketches(sets: DataFrame) -> DataFrame:
    """node and an odd sketch of FINE_SAMPLES MinHash values of its set."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lens = part.column("hashes").value_lengths().to_numpy(zero_copy_only=False)
                flat = part.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sketches = odd_sketch(minhash(np.split(flat, np.cumsum(lens)[:-1]), FINE_SAMPLES), FINE_WORDS).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lens) + 1, dtype=np.int32) * FINE_WORDS), pa.array(sketches.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h1"), lists], names=["doc_id", "h1", "fine"])

    out = sets.select("node.doc_id", "node.h1", "hashes").mapInArrow(run, "doc_id long, h1 long, fine array<long>")
    return out.select(F.struct("doc_id", "h1").alias("node"), "fine")


def close(a: Column, b: Column, most: int) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) <= most


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left, right = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    total = F.size("x").cast("long") + F.size("y")
    return both.withColumn("shared", shared).where(100 * F.col("shared") >= percent * (total - F.col("shared"))).select("a", "b")


def rest_of_buckets(members: DataFrame, most: int, block_rows: int, parts: int) -> DataFrame:
    """Pairs (a, b) of the given members of buckets whose components differ and whose sketches are close.

    members: key, band, n (bucket size), node, label, fine (sketch), bands. A bucket of more than block_rows members is
    dealt out as pairs of blocks, so no task holds more than two blocks of a bucket.
    """
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
        F.col("node.doc_id").alias("doc_id"), F.col("node.h1").alias("h1"), F.xxhash64("label").alias("label"), "fine", "bands",
    )
    dealt = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs_of(block: pa.Table):
        n = block.num_rows
        label, own = block["label"].to_numpy(), block["own"].to_numpy()
        if n < 2 or (label == label[0]).all():
            return None
        i, j, band = block["i"][0].as_py(), block["j"][0].as_py(), block["band"][0].as_py()
        sketch = block["fine"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, -1)
        bands = block["bands"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        mine, theirs = (np.arange(n), np.arange(n)) if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        left, right = [], []
        for at in range(0, len(mine), 64):
            rows = mine[at : at + 64]
            apart = np.bitwise_count(sketch[rows][:, None, :] ^ sketch[theirs][None, :, :]).sum(axis=2, dtype=np.int32)
            hit = (apart <= most) & (label[rows][:, None] != label[theirs][None, :])
            if i == j:
                hit &= rows[:, None] < theirs[None, :]
            p, q = np.nonzero(hit)
            p, q = rows[p], theirs[q]
            first = np.array([np.argmax(bands[a] == bands[b]) for a, b in zip(p, q)], dtype=np.int64) == band if len(p) else np.zeros(0, bool)
            left.append(p[first])
            right.append(q[first])
        p, q = np.concatenate(left), np.concatenate(right)
        if not len(p):
            return None
        ids, h1 = block["doc_id"].combine_chunks(), block["h1"].combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(p)), h1.take(pa.array(p)), ids.take(pa.array(q)), h1.take(pa.array(q))], names=["a_id", "a_h", "b_id", "b_h"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            mark = np.zeros(table.num_rows, bool)
            for c in ("key", "i", "j"):
                v = table[c].to_numpy()
                mark[1:] |= v[1:] != v[:-1]
            starts = np.concatenate([[0], np.flatnonzero(mark)]) if table.num_rows else np.zeros(0, int)
            for a, b in zip(starts[:-1], starts[1:]):
                if (out := pairs_of(table.slice(a, b - a))) is not None:
                    yield out
            held = table.slice(starts[-1]) if table.num_rows else held
        if held is not None and held.num_rows and (out := pairs_of(held)) is not None:
            yield out

    found = dealt.mapInArrow(run, "a_id long, a_h long, b_id long, b_h long")
    return found.select(F.struct(F.col("a_id").alias("doc_id"), F.col("a_h").alias("h1")).alias("a"), F.struct(F.col("b_id").alias("doc_id"), F.col("b_h").alias("h1")).alias("b"))


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, bands: int = 32, rows: int = 5, block_rows: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text). See the module for the method and the defined cases."""
    signed = cut(signatures(docs, width, bands, rows), "signatures")
    most = sketch_cut(percent / 100, bands * rows)
    classes = signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    classes = cut(classes.select("h1", "h2", F.struct("doc_id", "h1").alias("node"), "bands", "sketch"), "classes")

    placed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = placed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = cut(placed.join(buckets, "key"), "members")

    wanted = members.select(F.col("node.doc_id").alias("doc_id")).distinct()
    wanted = cut(wanted, "wanted")
    sets = cut(full_sets(semi_join_ids(docs.select("doc_id", "text"), wanted, "doc_id"), width), "sets")
    sketches = classes.select("node", "sketch")

    hubs = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    hubs = hubs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    first = components(confirmed(hubs.where(close(F.col("x"), F.col("y"), most)).select("a", "b"), sets, percent))

    labelled = members.where("n > 2").join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = cut(labelled, "labelled")
    mixed = labelled.where("node <> hub").groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    mixed = cut(labelled.join(mixed, "key").where("node <> hub"), "mixed")
    rest = mixed
    fine = cut(fine_sketches(sets.join(rest.select("node").distinct(), "node", "left_semi")), "fine")
    rest = rest.join(classes.select("node", "bands").join(fine, "node"), "node")
    near = rest_of_buckets(rest, sketch_cut(percent / 100, FINE_SAMPLES, FINE_WORDS), block_rows, partitions_of(mixed, growth=8))
    near = cut(near, "rest")
    more = confirmed(near, sets, percent)
    links = first.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)
    final = components(links).select("node", F.col("label.doc_id").alias("component_id"))
    discard(members, wanted, sets, labelled, mixed, fine, near, first)

    by_class = classes.join(final, "node", "left").select("h1", "h2", F.coalesce("component_id", "node.doc_id").alias("component_id"))
    ids = signed.select("doc_id", "n_shingles", "h1", "h2")
    linked = ids.where("n_shingles > 0").join(by_class, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id")
    alone = ids.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_per_component(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each component, columns as in docs.

    Rows are told apart by a key written beforehand, never by doc_id: repeated ids with different texts and null ids are
    linked like any others. The row with the least doc_id stays, null ids last; of equal ids, the one with the least hash
    of its text. A row with an empty set stays, but once for each non-null doc_id and text.
    """
    row = "near_dedup_row"
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), **options).select(F.col("doc_id").alias(row), "component_id")
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.xxhash64("text").alias("hash"), F.col(row))
    keep = keyed.select(row, least.alias("least")).join(found, row).groupBy("component_id").agg(F.min("least").alias("least")).select(F.col(f"least.{row}").alias(row))
    lone = keyed.join(keep, row, "left_semi").withColumn(row, F.when(F.col("doc_id").isNull(), F.col(row)))
    return lone.dropDuplicates(["doc_id", "text", row]).select(*docs.columns)
