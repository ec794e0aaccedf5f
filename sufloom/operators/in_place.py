"""Search in many texts by their transforms, each text's steps in one task.

transforms: suffixes.transforms(texts), one row a text, ordered by whole suffixes. What is asked of a text meets its transform
by one shuffle on seq_id; a task sorts both by text, transform first, and reads them as a stream: it holds one transform and
its letter counts, and a batch of what is asked. All steps of a batch are then taken by numpy, a character at a time for all
patterns, so there is no join for a character. One long text is searched by blocks (search.backward_search).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sufloom.operators import search
from sufloom.operators.ranking import CODES

SPAN = 1 << 18  # rows that are walked back at once


class Transform:
    """Letter counts of one text's transform."""

    def __init__(self, bwt: str, marks: bytes | None = None, samples: np.ndarray | None = None):
        codes = CODES[np.frombuffer(bwt.encode(), np.uint8)]
        self.codes, self.n = codes, len(codes)
        self.before = np.zeros((5, self.n + 1), np.int32)  # before[c, r]: how often c stands above row r; 4 is any other character
        for c in range(4):
            np.cumsum(codes == c, out=self.before[c, 1:])
        counts = self.before[:4, -1].astype(np.int64)
        self.base = np.append(1 + np.cumsum(counts) - counts, 0)
        self.marked = np.unpackbits(np.frombuffer(marks, np.uint8), count=self.n).astype(bool) if marks is not None else None
        self.samples = samples

    def search(self, codes: np.ndarray, first: np.ndarray, beg: np.ndarray, end: np.ndarray, left: np.ndarray, stop: int):
        """Ranges of patterns codes[first : first + left], taken from the right. An empty range, or one of at most stop rows, ends a search."""
        beg, end, left = beg.copy(), end.copy(), left.copy()
        left[beg >= end] = 0
        while True:
            at = np.flatnonzero((left > 0) & (end - beg > stop))
            if not len(at):
                return beg, end, left
            left[at] -= 1
            c = np.minimum(codes[first[at] + left[at]], 4)
            beg[at], end[at] = self.base[c] + self.before[c, beg[at]], self.base[c] + self.before[c, end[at]]

    def positions(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row: steps back until a sampled one is met."""
        at, out = rows.copy(), np.zeros(len(rows), np.int64)
        rank = np.append(0, np.cumsum(self.marked))
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            met = self.marked[at[open_]]
            done = open_[met]
            out[done] = self.samples[rank[at[done]]] + steps
            open_ = open_[~met]
            c = self.codes[at[open_]]
            at[open_] = self.base[c] + self.before[c, at[open_]]
            steps += 1
        return out


def _encoded(patterns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(p) for p in patterns], np.int64)
    text = "".join(p if p.isascii() else "".join(c if c.isascii() else "?" for c in p) for p in patterns)
    return CODES[np.frombuffer(text.encode(), np.uint8)], np.cumsum(lens) - lens, lens


def every_text(patterns: DataFrame, transforms: DataFrame, stop: int = 0) -> DataFrame:
    """search.backward_search of every pattern in every text: pattern_id, seq_id, beg, end, remaining. The result has a row
    for each pair, so it is for few patterns: they are shipped to all tasks, up to search.SMALL bytes. For more, and for
    matches alone, see matching_texts."""
    size = patterns.agg(F.sum(F.octet_length("pattern") + 16)).first()[0] or 0
    if size > search.SMALL:
        raise ValueError(f"more than {search.SMALL} bytes of patterns: see matching_texts")
    asked = patterns.where("pattern is not null").select("pattern_id", "pattern").collect()  # at most SMALL bytes
    ids, (codes, first, lens) = [r["pattern_id"] for r in asked], _encoded([r["pattern"] for r in asked])
    kind = dict(patterns.dtypes)["pattern_id"]

    def run(batches):
        for batch in batches:
            for seq_id, bwt in zip(batch.column("seq_id").to_pylist(), batch.column("bwt")):
                t = Transform(bwt.as_py())
                beg, end, left = t.search(codes, first, np.zeros(len(ids), np.int64), np.full(len(ids), t.n, np.int64), lens, stop)
                yield pa.RecordBatch.from_pydict({"pattern_id": ids, "seq_id": [seq_id] * len(ids), "beg": beg, "end": end, "remaining": left.astype(np.int32)})

    out = transforms.select("seq_id", "bwt").mapInArrow(run, f"pattern_id long, seq_id long, beg long, end long, remaining int")
    return out.withColumn("pattern_id", F.col("pattern_id").cast(kind))


def _met(asked: DataFrame, transforms: DataFrame, answer, schema: str, sampled: bool = False) -> DataFrame:
    """answer(transform, batch) for the rows of asked (seq_id, ...), batch by batch, where the text has a transform."""
    extra = [F.col(c) for c in ("marks", "samples")] if sampled else [F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("array<long>").alias("samples")]
    names = [c for c in asked.columns if c != "seq_id"]
    held = transforms.select("seq_id", F.lit(0).alias("_kind"), "bwt", *extra)
    both = held.unionByName(asked.withColumn("_kind", F.lit(1)), allowMissingColumns=True)

    def run(batches):
        now, t = None, None
        for batch in batches:
            seq, kind = batch.column("seq_id").to_numpy(), batch.column("_kind").to_numpy()
            edges = np.flatnonzero(np.append(True, (seq[1:] != seq[:-1]) | (kind[1:] != kind[:-1]))).tolist() + [len(seq)] if len(seq) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if kind[a] == 0:
                    now = int(seq[a])
                    samples = batch.column("samples")[a]
                    loaded = batch.slice(a, 1)
                    t = None  # read when something is asked of it
                    continue
                if now != int(seq[a]):
                    continue
                if t is None:
                    t = Transform(loaded.column("bwt")[0].as_py(), loaded.column("marks")[0].as_py(), np.array(samples.values.to_numpy()) if sampled else None)
                yield from answer(t, now, batch.slice(a, b - a).select(names))

    return both.repartition("seq_id").sortWithinPartitions("seq_id", "_kind").mapInArrow(run, schema)


def ranges(starts: DataFrame, transforms: DataFrame, stop: int = 0) -> DataFrame:
    """pattern_id, seq_id, beg, end, remaining of starts (pattern_id, pattern, seq_id, beg, end): each pattern searched
    ahead of what its range holds."""
    kind = dict(starts.dtypes)["pattern_id"]

    def answer(t, seq_id, batch):
        codes, first, lens = _encoded(batch.column("pattern").to_pylist())
        beg, end, left = t.search(codes, first, batch.column("beg").to_numpy(), batch.column("end").to_numpy(), lens, stop)
        yield pa.RecordBatch.from_arrays([batch.column("pattern_id"), pa.array(np.full(len(beg), seq_id)), pa.array(beg), pa.array(end), pa.array(left.astype(np.int32))], names=["pattern_id", "seq_id", "beg", "end", "remaining"])

    asked = starts.where("pattern is not null").select("pattern_id", "pattern", "seq_id", F.col("beg").cast("long").alias("beg"), F.col("end").cast("long").alias("end"))
    return _met(asked, transforms, answer, f"pattern_id {kind}, seq_id long, beg long, end long, remaining int")


def matching_texts(patterns: DataFrame, lookup: DataFrame, transforms: DataFrame, length: int = 4) -> DataFrame:
    """pattern_id, seq_id, beg, end of each text that holds the pattern; patterns of any length and number. The search starts
    from the lookup (index.kmer_lookup of `length` characters): only texts in which a pattern's last characters occur are
    asked, from the rows that the lookup gives. Patterns shorter than that start from their last letter's rows; an empty one
    has all rows."""
    tail = F.substring(F.col("pattern"), -length, length)
    long = patterns.where(F.length("pattern") >= length).select("pattern_id", F.expr(f"left(pattern, length(pattern) - {length})").alias("pattern"), tail.alias("kmer"))
    seeded = long.join(lookup.select("seq_id", "kmer", "beg", "end"), "kmer").drop("kmer")
    next_of = {"A": "c_C", "C": "c_G", "G": "c_T", "T": "n"}
    letters = F.array(F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("beg"), F.col("n").alias("end")), *(F.struct(F.lit(c).alias("last"), F.col(f"c_{c}").alias("beg"), F.col(e).alias("end")) for c, e in next_of.items()))
    firsts = transforms.select("seq_id", F.explode(letters).alias("x")).select("seq_id", "x.*").where("beg < end")
    short = patterns.where(F.length("pattern") < length).select("pattern_id", F.expr("left(pattern, length(pattern) - 1)").alias("pattern"), F.substring("pattern", -1, 1).alias("last"))
    starts = seeded.unionByName(short.join(firsts, "last").drop("last"))
    found = ranges(starts, transforms)
    return found.where("beg < end").select("pattern_id", "seq_id", "beg", "end")


def located(found: DataFrame, transforms: DataFrame) -> DataFrame:
    """pattern_id, seq_id, r, pos of all rows of the ranges (pattern_id, seq_id, beg, end), from each text's samples alone."""
    kind = dict(found.dtypes)["pattern_id"]

    def answer(t, seq_id, batch):
        ids, beg, end = batch.column("pattern_id").to_pylist(), batch.column("beg").to_pylist(), batch.column("end").to_pylist()
        for i, b, e in zip(ids, beg, end):
            for at in range(b, e, SPAN):
                rows = np.arange(at, min(e, at + SPAN))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), id_type), pa.array(np.full(len(rows), seq_id)), pa.array(rows), pa.array(t.positions(rows))], names=["pattern_id", "seq_id", "r", "pos"])

    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return _met(found.where("beg < end").select("pattern_id", "seq_id", "beg", "end"), transforms, answer, f"pattern_id {kind}, seq_id long, r long, pos long", sampled=True)


def inverse(transforms: DataFrame) -> DataFrame:
    """seq_id, text of each transform (seq_id, bwt), from its last character to its first, by steps in the task that holds it."""

    def run(batches):
        for batch in batches:
            for seq_id, bwt in zip(batch.column("seq_id").to_pylist(), batch.column("bwt")):
                data = np.frombuffer(bwt.as_py().encode(), np.uint8)
                to = np.empty(len(data), np.int64)
                to[np.argsort(np.where(data == ord("$"), 0, data), kind="stable")] = np.arange(len(data))
                steps, met, row = to.tolist(), [0] * (len(data) - 1), 0
                for i in range(len(data) - 2, -1, -1):
                    met[i] = row
                    row = steps[row]
                yield pa.RecordBatch.from_arrays([pa.array([seq_id]), pa.array([data[np.array(met, np.int64)].tobytes().decode()])], names=["seq_id", "text"])

    return transforms.select("seq_id", "bwt").mapInArrow(run, "seq_id long, text string")
