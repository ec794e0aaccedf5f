"""FASTQ text read by many tasks: a scan of parser states over the splits of the files.

Records may span lines and the quality may hold any character, so a line that begins with @ tells nothing by itself: it
depends on all lines before it whether it is a name. A split is therefore read as a function from the parser's state at its
start to the state at its end. There are three kinds of state: between records, in a sequence with n characters so far, in
a quality with n characters to go. For every line at which a record may begin the end state follows from that of a later
line, from the last line to the first; lines with equal end states in a row are one entry, and as parsers that begin
anywhere soon agree, few entries are left. The driver takes these entries (a short row a split), follows the states from
split to split, and the splits are read once more, each from its true state. Records within a split never leave its task;
of a record that goes on into other splits each task gives a part, and the parts meet by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BETWEEN, SEQUENCE, QUALITY = 0, 1, 2
State = tuple[int, int]
SUMMARY = "file string, block long, total long, plus_at long, plus_end long, bounds array<long>, kinds array<int>, counts array<long>"


def summary(lens: np.ndarray, at: np.ndarray, plus: np.ndarray) -> tuple:
    """total, plus_at, plus_end, bounds, kinds, counts of a split whose lines have these lengths and begin with @ or +: the
    characters in all; those before and behind the first line with + (-1: none); and the end states of parsers that are
    between records where bounds[i - 1] < characters before <= bounds[i]."""
    m = len(lens)
    cum = np.append(0, np.cumsum(lens))
    following = np.full(m + 2, m)  # the first line with + from each line on
    for i in range(m - 1, -1, -1):
        following[i] = i if plus[i] else following[i + 1]
    ends: list[State] = [(BETWEEN, 0)] * (m + 1)
    for i in range(m - 1, -1, -1):
        ends[i] = ends[i + 1] if not at[i] else _behind(cum, int(following[i + 1]), 0, i + 1, ends)
    bounds, kinds, counts = [], [], []
    # Lines without characters share a place; a quality ends at the first line that reaches it.
    firsts = np.flatnonzero(np.append(True, cum[1:] != cum[:-1]))
    for t in firsts.tolist():
        if kinds and (kinds[-1], counts[-1]) == ends[t]:
            bounds[-1] = int(cum[t])
        else:
            bounds.append(int(cum[t]))
            kinds.append(ends[t][0])
            counts.append(ends[t][1])
    j = int(following[0])
    return int(cum[m]), int(cum[j]) if j < m else -1, int(cum[j + 1]) if j < m else -1, bounds, kinds, counts


def _behind(cum: np.ndarray, j: int, before: int, start: int, ends: list[State]) -> State:
    """The end state of a parser in a sequence that began at line `start` with `before` characters, j being the next line with +."""
    m = len(cum) - 1
    if j >= m:
        return SEQUENCE, int(before + cum[m] - cum[start])
    n = int(before + cum[j] - cum[start])
    if n == 0:
        return ends[j + 1]
    t = int(np.searchsorted(cum, cum[j + 1] + n))
    return (QUALITY, int(n - (cum[m] - cum[j + 1]))) if t > m else ends[t]


def exit_state(state: State, s) -> tuple[State, bool]:
    """The state at the split's end, and whether the record that was open at its start still is."""
    kind, n = state
    if kind == SEQUENCE:
        if s["plus_at"] < 0:
            return (SEQUENCE, n + s["total"]), True
        n += s["plus_at"]
        target = s["plus_end"] + n
    else:
        target = n
    if target > s["total"]:
        return (QUALITY, target - s["total"]), True
    i = int(np.searchsorted(s["bounds"], target))
    return (s["kinds"][i], s["counts"][i]), False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _splits(batches):
    """(file, block, lines) in the order read; a split comes in several parts."""
    for batch in batches:
        file, block = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        edges = [0, *(i for i in range(1, len(file)) if block[i] != block[i - 1] or file[i] != file[i - 1]), len(file)] if file else []
        for a, z in zip(edges[:-1], edges[1:]):
            yield file[a], int(block[a]), batch.column("value").slice(a, z - a)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name (up to the first space or tab), seq, qual of each record of FASTQ text. Lines before a name are passed over; a
    record that the file's end cuts off has what there is of it. An unsplittable (gzip) file is one split."""
    lines = _lines(spark, path)

    def summaries(batches):
        import pyarrow.compute as pc

        now, parts = None, []

        def out():
            lens, at, plus = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_pylist([dict(zip(names, (*now, *summary(lens, at, plus))))], schema=schema)

        names = [x.split(" ")[0] for x in SUMMARY.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
        schema = pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in SUMMARY.split(", ")])
        for file, block, value in _splits(batches):
            if now is not None and now != (file, block):
                yield out()
                parts = []
            now = (file, block)
            parts.append((pc.utf8_length(value).to_numpy().astype(np.int64), pc.starts_with(value, "@").to_numpy(zero_copy_only=False), pc.starts_with(value, "+").to_numpy(zero_copy_only=False)))
        if now is not None:
            yield out()

    entries: dict[tuple[str, int], tuple[State, int]] = {}  # of each split: the state, and the split in which the open record began
    state, owner, before = (BETWEEN, 0), -1, None
    for s in lines.mapInArrow(summaries, SUMMARY).orderBy("file", "block").collect():  # a short row a split
        if s["file"] != before:
            state, owner, before = (BETWEEN, 0), -1, s["file"]
        entries[s["file"], s["block"]] = (state, owner)
        state, same = exit_state(state, s)
        owner = owner if same else s["block"]

    def records(batches):
        now, out, state, n, name, seq, qual, owner = None, [], BETWEEN, 0, None, [], [], -1

        def part(whole):
            return (None if whole else now[0], None if whole else owner, None if whole else now[1], name, "".join(seq), "".join(qual))

        def batch():
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["file", "owner", "block", "name", "seq", "qual"])

        for file, block, value in _splits(batches):
            if now != (file, block):
                if now is not None and state != BETWEEN:
                    out.append(part(False))
                now, name, seq, qual = (file, block), None, [], []
                (state, n), owner = entries[now]
            for line in value.to_pylist():
                if state == BETWEEN:
                    if line.startswith("@"):
                        state, n, name, seq, qual, owner = SEQUENCE, 0, line[1:].replace("\t", " ").split(" ")[0], [], [], block
                    continue
                if state == SEQUENCE:
                    if not line.startswith("+"):
                        seq.append(line)
                        n += len(line)
                        continue
                    state = QUALITY
                else:
                    qual.append(line)
                    n -= len(line)
                if n <= 0:
                    out.append(part(name is not None))
                    state = BETWEEN
            if len(out) >= 2000:
                yield batch()
                out = []
        if now is not None and state != BETWEEN:
            out.append(part(False))
        if out:
            yield batch()

    # A part has the file and the split in which its record began; a whole record has neither.
    parts = lines.mapInArrow(records, "file string, owner long, block long, name string, seq string, qual string")
    whole = parts.where("owner is null").select("name", "seq", "qual")
    x = F.array_sort(F.collect_list(F.struct("block", "name", "seq", "qual")))
    cut = parts.where("owner is not null").groupBy("file", "owner").agg(x.alias("x"))
    return whole.unionByName(cut.select(F.element_at("x.name", 1).alias("name"), F.array_join("x.seq", "").alias("seq"), F.array_join("x.qual", "").alias("qual")))
