"""Order of the suffixes of long DNA texts, by packed characters and then by refinement of ties alone.

A text is rows (seq_id, block, text) of CHUNK characters each. The first 64 characters of a suffix are two 64-bit numbers,
so what is sorted over range partitions is (numbers, position) and no strings; an order by at most 32 takes one number. (Of
texts with few different letters most suffixes tie on 32 characters: 84 % of the turns of check_s, and 11 % on 64.) Only
suffixes that tie on both go on:

* up to k characters (k <= CHUNK): the rest of the k characters is fetched by position from the blocks, four to a byte,
  and sorted within the groups of ties; what still ties is in order of position;
* by whole suffixes: prefix doubling. A tied suffix takes the rank of the suffix h characters on, h = 64, 128, ...
  Ranks that are settled are read by position; rows that a round settles leave for good, so rounds rank ever fewer rows.

Groups of ties may span range partitions (a run of one letter may fill many). Each partition notes where groups begin in
it and whether its first and last row go on in the next; one small row a partition then gives all ranks, so no group is
ever gathered in a task.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sufloom.operators.ranking import CODES, strings
from sufloom.sources.scratch import discard, materialize

CHUNK = 256
WORD = 32  # characters of a key
FIRST = 2 * WORD  # characters that the first sort compares
ROWS_EACH = 1 << 20  # suffixes for each range partition
LETTERS = np.frombuffer(b"ACGT", np.uint8)
log = logging.getLogger(__name__)


def blocks_of(texts: DataFrame) -> DataFrame:
    """seq_id, block, text of texts (seq_id, text), cut in one pass over each."""
    cut = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return texts.select("seq_id", F.posexplode(cut).alias("block", "text")).select("seq_id", F.col("block").cast("long").alias("block"), "text")


def pieces_of(blocks: DataFrame, ahead: int = CHUNK) -> DataFrame:
    """Each block with before (the character ahead of it, null at the text's start) and tail (the next `ahead` characters,
    null behind the last block): a block offers its ends to its neighbours, and one grouping brings them together."""
    none = F.lit(None).cast("string")
    own = F.struct("block", F.col("text").alias("text"), none.alias("before"), none.alias("tail"))
    to_last = F.struct((F.col("block") - 1).alias("block"), none.alias("text"), none.alias("before"), F.substring("text", 1, ahead).alias("tail"))
    to_next = F.struct((F.col("block") + 1).alias("block"), none.alias("text"), F.substring(F.col("text"), F.length("text"), F.lit(1)).alias("before"), none.alias("tail"))
    offers = blocks.select("seq_id", F.explode(F.array(own, to_last, to_next)).alias("x")).select("seq_id", "x.*")
    return offers.groupBy("seq_id", "block").agg(*(F.max(c).alias(c) for c in ("text", "before", "tail"))).where("text is not null")


def _ascii(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of strings, and where each ends, from 0."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)), ends - ends[0]


def words_at(codes: np.ndarray, places: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The numbers of the `has` characters (0 to 32, the rest counts as A) from each place, as signed integers of the same order."""
    key = np.zeros(len(codes) + 2 * WORD, np.uint64)
    key[: len(codes)] = codes
    width = 1
    while width < WORD:
        key[:-width] = (key[:-width] << np.uint64(2 * width)) | key[width:]
        width *= 2
    key, short = key[places], has < WORD
    drop = (2 * (WORD - has[short])).astype(np.uint64)
    kept = (key[short] >> np.minimum(drop, np.uint64(63))) << np.minimum(drop, np.uint64(63))
    key[short] = np.where(has[short] == 0, np.uint64(0), kept)
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def first_words(pieces: DataFrame, k: int = WORD) -> DataFrame:
    """seq_id, pos, key, has, before of all suffixes, and key2 where k is over 32: the numbers of the first min(k, 64)
    characters, 32 each, and how many there are; before is the code of the character ahead, 4 at the start."""
    most, wide = min(k, FIRST), k > WORD

    def run(batches):
        for batch in batches:
            seq, block = batch.column("seq_id").to_numpy(), batch.column("block").to_numpy()
            own, own_ends = _ascii(batch.column("text"))
            tail, tail_ends = _ascii(pc.utf8_slice_codeunits(pc.fill_null(batch.column("tail"), ""), 0, most))
            own_len, tail_len = np.diff(own_ends), np.diff(tail_ends)
            size = own_len + tail_len
            starts = np.cumsum(size) - size
            data = np.empty(size.sum(), np.uint8)
            for source, ends, lens, shift in ((own, own_ends, own_len, 0), (tail, tail_ends, tail_len, own_len)):
                data[np.repeat(starts + shift - ends[:-1], lens) + np.arange(len(source))] = source
            codes = CODES[data]
            if (codes > 3).any():
                raise ValueError("packed texts hold A, C, G, T alone")
            rows = own_len + batch.column("tail").is_null().to_numpy(zero_copy_only=False)
            local = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
            places = np.repeat(starts, rows) + local
            has = np.minimum(np.repeat(size, rows) - local, most)
            ahead = np.full(len(rows), 4, np.int8)
            first, ends = _ascii(pc.fill_null(batch.column("before"), ""))
            ahead[np.diff(ends) > 0] = CODES[first]
            before = np.where(local == 0, np.repeat(ahead, rows), codes[np.maximum(places - 1, 0)] if len(codes) else 4)
            keys = [words_at(codes, places, np.minimum(has, WORD))] + ([words_at(codes, places + WORD, np.maximum(has - WORD, 0))] if wide else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(seq, rows)), pa.array(np.repeat(block * CHUNK, rows) + local), *map(pa.array, keys), pa.array(has.astype(np.int8)), pa.array(before.astype(np.int8))],
                names=["seq_id", "pos", "key", *["key2"][: len(keys) - 1], "has", "before"],
            )

    return pieces.mapInArrow(run, f"seq_id long, pos long, key long, {'key2 long, ' if wide else ''}has byte, before byte")


def fetched(rows: DataFrame, pieces: DataFrame, at: Column, size: int, out: str = "found") -> DataFrame:
    """rows (seq_id, ...) with `out`: up to `size` (at most CHUNK) characters of their text from position `at`."""
    text = pieces.select("seq_id", F.col("block").alias("_block"), F.concat("text", F.coalesce("tail", F.lit(""))).alias("_piece"))
    asked = rows.withColumn("_at", at).withColumn("_block", F.expr(f"_at div {CHUNK}"))
    return asked.join(text, ["seq_id", "_block"], "left").withColumn(out, F.coalesce(F.substring(F.col("_piece"), (F.col("_at") % CHUNK + 1).cast("int"), F.lit(size)), F.lit(""))).drop("_at", "_block", "_piece")


def packed_rest(rows: DataFrame, size: int) -> DataFrame:
    """rows with found replaced by key, its characters four to a byte, padded with A to `size`, and has, their number."""
    names = [c for c in rows.columns if c != "found"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for batch in batches:
            data, ends = _ascii(batch.column("found"))
            lens = np.diff(ends)
            codes = np.zeros((len(lens), -(-size // 4) * 4), np.uint8)
            codes[np.repeat(np.arange(len(lens)), lens), np.arange(len(data)) - np.repeat(ends[:-1], lens)] = CODES[data]
            four = codes.reshape(len(lens), -1, 4)
            key = four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]
            wide = pa.Array.from_buffers(pa.binary(key.shape[1]), len(lens), [None, pa.py_buffer(np.ascontiguousarray(key))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), wide, pa.array(lens.astype(np.int16))], names=[*names, "key", "has"])

    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", key binary, has short")


def ranked_within(rows: DataFrame, group: list[str], keys: list[str], parts: int, spent: tuple[str, ...] = ()) -> DataFrame:
    """rows with within (place in the group's order by keys, then pos, from 0), first (that of the first row with the same
    keys) and tied (another row has them). Rows are sorted over range partitions and written once; the columns `spent` are
    written for the first and last row of a partition alone and null elsewhere."""
    order = [*group, *keys, "pos"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = list(rows.columns)

    def run(batches):
        from pyspark import TaskContext

        part, at, outer, inner, held, held_tied = TaskContext.get().partitionId(), 0, -1, -1, None, False

        def changes(table, columns):
            out = np.zeros(table.num_rows - 1, bool)
            for c in columns:
                a = table.column(c)
                out |= pc.not_equal(a.slice(1), a.slice(0, table.num_rows - 1)).to_numpy()
            return out

        def rows_out(table, outer, inner, tied, last):
            n = table.num_rows
            for c in spent:
                own = table.column(c)
                table = table.set_column(names.index(c), c, pc.if_else(pa.array(last | (np.arange(at, at + n) == 0)), own, pa.scalar(None, own.type)))
            more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(outer), pa.array(inner), pa.array(tied), pa.array(last)]
            return pa.Table.from_arrays([*table.columns, *more], names=[*names, "part", "idx", "outer", "inner", "tied", "last"]).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            n = table.num_rows
            new_outer = changes(table, group)
            new_inner = new_outer | changes(table, keys)
            # For rows 1 .. n - 1 of the table: where their group began, in rows of the partition.
            index = np.arange(at + 1, at + n)
            outers = np.concatenate([[outer], np.maximum.accumulate(np.where(new_outer, index, outer))]) if n > 1 else np.array([outer])
            inners = np.concatenate([[inner], np.maximum.accumulate(np.where(new_inner, index, inner))]) if n > 1 else np.array([inner])
            tied = np.zeros(n, bool)
            tied[0] = held_tied
            tied[:-1] |= ~new_inner
            tied[1:] |= ~new_inner
            yield from rows_out(table.slice(0, n - 1), outers[:-1], inners[:-1], tied[:-1], np.zeros(n - 1, bool))
            held, held_tied, outer, inner, at = table.slice(n - 1), bool(tied[-1]), int(outers[-1]), int(inners[-1]), at + n - 1
        if held is not None:
            yield from rows_out(held, np.array([outer]), np.array([inner]), np.array([held_tied]), np.array([True]))

    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = materialize(dealt.mapInArrow(run, f"{kinds}, part int, idx long, outer long, inner long, tied boolean, last boolean"), "ranked")
    ends = done.where("last or idx = 0").select("part", "idx", "outer", "inner", "last", F.struct(*group, F.lit(0)).alias("g"), F.struct(*group, *keys).alias("k")).collect()  # two rows a partition
    heads, lasts = {r["part"]: r for r in ends if r["idx"] == 0}, {r["part"]: r for r in ends if r["last"]}
    base, carried, before = 0, [], None
    for part in sorted(heads):
        head, last = heads[part], lasts[part]
        same_outer, same_inner = before is not None and before[0] == head["g"], before is not None and before[1] == head["k"]
        outer, inner = (before[2] if same_outer else base), (before[3] if same_inner else base)
        if same_inner and carried:
            carried[-1][5] = True
        carried.append([part, base, outer, inner, same_inner, False])
        before = (last["g"], last["k"], outer if last["outer"] < 0 else base + last["outer"], inner if last["inner"] < 0 else base + last["inner"])
        base += last["idx"] + 1
    table = rows.sparkSession.createDataFrame(carried, "part int, _base long, _outer long, _inner long, _from_last boolean, _to_next boolean")
    joined = done.join(F.broadcast(table), "part")
    outer = F.when(F.col("outer") < 0, F.col("_outer")).otherwise(F.col("_base") + F.col("outer"))
    inner = F.when(F.col("inner") < 0, F.col("_inner")).otherwise(F.col("_base") + F.col("inner"))
    tied = F.col("tied") | ((F.col("inner") < 0) & F.col("_from_last")) | (F.col("last") & F.col("_to_next"))
    return joined.select(*names, (F.col("_base") + F.col("idx") - outer).alias("within"), (inner - outer).alias("first"), tied.alias("tied"))


def ordered(blocks: DataFrame, k: int | None = WORD, single: bool = True, counts: list[int] | None = None) -> DataFrame:
    """seq_id, r, pos, key, has, before: the suffix array of texts given as blocks, by k characters and then position, or
    (None, or more than CHUNK) by prefix doubling until all are told apart, or k are compared. key is that of the
    first 32 characters, has the number of those compared first, 64 at most, before the code of the character ahead.

    single: there is one text. counts takes the number of rows that each round ranks.
    """
    spark = blocks.sparkSession
    texts = [] if single else ["seq_id"]
    deep = k is None or k > CHUNK
    pieces = materialize(pieces_of(blocks, CHUNK), "pieces")
    size = pieces.agg(F.sum(F.length("text"))).first()[0] or 0
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = [] if counts is None else counts
    counts.append(size + 1)

    def parts(rows: int) -> int:
        return max(1, min(least, -(-rows // 10_000)), rows // ROWS_EACH)

    reach = FIRST if deep else k
    words = ["key", "key2"] if reach > WORD else ["key"]
    table = ranked_within(first_words(pieces, reach), texts, [*words, "has"], parts(size), tuple(words[1:]))
    rows = table.select("seq_id", "pos", "key", "has", "before", F.col("within").alias("r"), F.col("first").alias("rk"), "tied")
    if not deep and k <= FIRST:
        return rows.select("seq_id", "r", "pos", "key", "has", "before")
    kept = rows.select("seq_id", "pos", "key", "has", "before", "tied", "r")
    settled = rows.where("not tied").select("seq_id", "pos", F.col("r").alias("rk"))
    open_ = rows.where("tied").select("seq_id", "pos", "rk")
    if not deep:
        m = open_.count()
        counts.append(m)
        rest = packed_rest(fetched(open_, pieces, F.col("pos") + FIRST, k - FIRST), k - FIRST)
        again = ranked_within(rest, [*texts, "rk"], ["key", "has"], parts(m))
        places = again.select("seq_id", "pos", (F.col("rk") + F.col("within")).alias("better"))
        return kept.where("not tied").drop("tied").unionByName(kept.where("tied").drop("tied", "r").join(places, ["seq_id", "pos"]).withColumnRenamed("better", "r")).select("seq_id", "r", "pos", "key", "has", "before")
    finished, h = [], FIRST
    while (m := open_.count()) and (k is None or h < k):
        counts.append(m)
        log.info("%d characters compared, %d suffixes tied", h, m)
        latest = open_  # ranks of all rows that tied at first
        for f in finished:
            latest = latest.unionByName(f)
        latest = latest.select("seq_id", F.col("pos").alias("_at"), F.col("rk").alias("_open"))
        asked = open_.withColumn("_at", F.col("pos") + h).join(latest, ["seq_id", "_at"], "left")
        asked = materialize(asked, "ahead")
        known = settled.select("seq_id", F.col("pos").alias("_at"), F.col("rk").alias("_settled"))
        met = asked.where("_open is not null").select("seq_id", "pos", "rk", F.col("_open").alias("key"))
        other = asked.where("_open is null").join(known, ["seq_id", "_at"]).select("seq_id", "pos", "rk", F.col("_settled").alias("key"))
        again = ranked_within(met.unionByName(other), [*texts, "rk"], ["key"], parts(m))
        discard(asked)  # again is written
        now = again.select("seq_id", "pos", (F.col("rk") + F.col("first")).alias("rk"), (F.col("rk") + F.col("within")).alias("r"), "tied")
        finished.append(now.where("not tied").select("seq_id", "pos", "rk"))
        open_ = now.where("tied").select("seq_id", "pos", "rk")
        last = now.where("tied").select("seq_id", "pos", F.col("r").alias("rk"))  # by position, where k ends the rounds
        h *= 2
    if len(counts) == 1:
        if m:
            counts.append(m)
        return rows.select("seq_id", "r", "pos", "key", "has", "before")
    places = last
    for f in finished:
        places = places.unionByName(f)
    places = places.withColumnRenamed("rk", "better")
    tied = kept.where("tied").drop("tied", "r").join(places, ["seq_id", "pos"]).withColumnRenamed("better", "r")
    return kept.where("not tied").drop("tied").unionByName(tied).select("seq_id", "r", "pos", "key", "has", "before")


def unpacked(rows: DataFrame, carry: int = WORD) -> DataFrame:
    """seq_id, r, pos, p (the first min(carry, 32) characters) and bwt of the rows of ordered()."""
    carry = min(carry, WORD)

    def run(batches):
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            has = np.minimum(batch.column("has").to_numpy().astype(np.int64), carry)
            shifts = np.uint64(62) - 2 * np.arange(carry, dtype=np.uint64)
            letters = LETTERS[(key[:, None] >> shifts[None, :]) & np.uint64(3)] if carry else np.zeros((len(key), 0), np.uint8)
            before = batch.column("before").to_numpy()
            inner = before < 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("seq_id"), batch.column("r"), batch.column("pos"), strings(letters[np.arange(carry)[None, :] < has[:, None]], has), strings(LETTERS[before[inner]], inner.astype(np.int64), ~inner)],
                names=["seq_id", "r", "pos", "p", "bwt"],
            )

    return rows.select("seq_id", "r", "pos", "key", "has", "before").mapInArrow(run, "seq_id long, r long, pos long, p string, bwt string")
