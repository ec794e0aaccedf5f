"""Packing documents into sequences of a fixed length by cutting-stock column generation.

A document's ids and the end id are cut into full pieces, which are sequences of their own, and one shorter rest. The
histogram of the rests' lengths (fewer than `capacity` numbers, however many documents) is all that reaches the driver.
There a linear program over packing patterns is solved by column generation: a knapsack dynamic program prices new
patterns against the dual values until the gap to a proven bound is under `gap`, or hardly closes any more (see
solve_patterns, which also reports value, bound and rounds). Pattern counts are rounded and what remains is packed
greedily by decreasing length. Documents, ranked within each length, then take the pattern slots of that length, in tasks.

Defined results: a null or empty text is the end id alone. Repeated rows are packed as often as they come. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sufloom.llm.common import cut, small_batches
from sufloom.llm.token_output import texts_of
from sufloom.llm.tokenize import encoder as encoder_of

Pattern = tuple[dict[int, int], int]  # pieces of each length, number of sequences


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value of a multiset of lengths with sum at most c, for each c up to len(prices) - 1, and the length
    taken last for it (0: none). prices[l] is the value of length l."""
    capacity = len(prices) - 1
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    items = np.flatnonzero(prices > 0)
    values = prices[items]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := int(np.searchsorted(items, c, side="right")):
            offers = best[c - items[:n]] + values[:n]
            k = int(offers.argmax())
            if offers[k] > best[c]:
                best[c], last[c] = offers[k], items[k]
    return best, last


def taken_of(last: np.ndarray, room: int) -> dict[int, int]:
    """The multiset that knapsack() found for that room."""
    out: dict[int, int] = {}
    while room > 0:
        if last[room]:
            out[int(last[room])] = out.get(int(last[room]), 0) + 1
        room -= max(1, int(last[room]))
    return out


def greedy(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Packs counts of lengths, the longest that fits first; equal sequences in a row are one pattern."""
    left = {l: n for l, n in left.items() if n > 0}
    out: list[Pattern] = []
    while left:
        room, taken = capacity, {}
        for l in sorted(left, reverse=True):
            if k := min(left[l], room // l):
                taken[l] = k
                room -= k * l
        times = min(left[l] // k for l, k in taken.items())
        for l, k in taken.items():
            left[l] -= k * times
            if not left[l]:
                del left[l]
        out.append((taken, times))
    return out


class Master:
    """The linear program over the patterns found so far, by the revised simplex method: as few sequences as hold at least
    each length's pieces. It begins with one pattern of each length alone, whose inverse is exact."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int):
        self.at = {int(l): i for i, l in enumerate(lengths)}
        self.columns: list[dict[int, int]] = [{int(l): int(capacity // l)} for l in lengths]
        self.demand = demand
        self.cost = np.ones(len(lengths))
        self.inverse = np.diag(1.0 / (capacity // lengths))
        self.x = np.einsum("ij,j->i", self.inverse, demand)
        self.prices = np.einsum("i,ij->j", self.cost, self.inverse)
        self.pivots = 0

    def value(self) -> float:
        return float((self.cost * self.x).sum())

    def enter(self, pattern: dict[int, int], cost: float) -> bool:
        """Brings a column into the basis if that lowers the value; its reduced cost is the price of what it holds, less its cost."""
        rows, counts = [self.at[l] for l in pattern], np.array(list(pattern.values()), float)
        gain = float((self.prices[rows] * counts).sum()) - cost
        if gain <= 1e-9:
            return False
        step = (self.inverse[:, rows] * counts).sum(axis=1)
        able = step > 1e-9
        if not able.any():
            return False
        ratio = np.where(able, self.x / np.where(able, step, 1), np.inf)
        r = int(ratio.argmin())
        t, row = ratio[r], self.inverse[r] / step[r]
        self.inverse -= np.outer(step, row)
        self.inverse[r] = row
        self.x = np.maximum(self.x - t * step, 0)
        self.x[r], self.columns[r], self.cost[r] = t, pattern, cost
        self.prices = self.prices - gain * row
        self.pivots += 1
        if self.pivots % 100 == 0:  # sums taken anew; errors of the inverse cost sequences at most, as packings and bounds are checked apart
            self.x = np.maximum(np.einsum("ij,j->i", self.inverse, self.demand), 0)
            self.prices = np.einsum("i,ij->j", self.cost, self.inverse)
        return True


class Solution(NamedTuple):
    """Patterns with their numbers; the linear program's value, the bound proven for any packing, rounds of pricing, and
    the greatest value that the last round found for a pattern (1: none can better the program)."""

    patterns: list[Pattern]
    value: float
    bound: float
    rounds: int
    best: float

    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def solve_patterns(histogram: dict[int, int], capacity: int, gap: float = 0.0002, columns: int = 24, patience: int = 60) -> Solution:
    """Patterns and their numbers that together hold exactly the histogram's pieces.

    Column generation: a knapsack prices patterns at a mean of the program's dual prices and of those with the best bound so
    far (length / capacity at first); each round up to `columns` patterns enter. It ends when the program's value is within
    `gap` of the bound or not above the bound rounded up to whole sequences, when no pattern is worth more than 1, or when
    `patience` rounds have closed less than a twentieth of what is left to the bound. The program's whole parts are taken,
    then its largest fractions where they fit, and the rest is packed greedily; a greedy packing of all that takes fewer
    sequences goes first.
    """
    lengths = np.array(sorted(l for l, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return Solution([], 0.0, 0.0, 0, 1.0)
    real = np.array([histogram[int(l)] for l in lengths], float)
    plain = greedy(dict(histogram), capacity)
    bound, centre = float((real * lengths).sum()) / capacity, lengths / capacity
    # Slightly uneven demands keep the simplex method from standing still among equal ones.
    master = Master(lengths, real + np.random.default_rng(5).uniform(0.5, 1, len(lengths)) * 1e-4, capacity)
    for p, _ in plain:
        master.enter(p, 1.0)
    rounds, best, marks = 0, np.inf, [master.value()]
    while master.value() > max(bound * (1 + gap), np.ceil(bound - 1e-6) + 1e-6):
        if len(marks) > patience and marks[-1 - patience] - marks[-1] < 0.05 * (marks[-1] - bound):
            break
        for i in np.argsort(master.prices)[:columns].tolist():
            if master.prices[i] < -1e-9:
                master.enter({int(lengths[i]): -1}, 0.0)  # a piece too many
        share, entered = 0.5, 0
        while not entered:
            mean = np.maximum(share * centre + (1 - share) * master.prices, 0)
            prices = np.zeros(capacity + 1)
            prices[lengths] = mean
            most, last = knapsack(prices)
            best = float(most[capacity])
            if (proven := float((mean * real).sum()) / best) > bound:
                bound, centre = proven, mean / best
            seen = set()
            for i in np.argsort(-(mean + most[capacity - lengths]), kind="stable")[: 6 * columns].tolist():
                p = taken_of(last, capacity - int(lengths[i]))
                p[int(lengths[i])] = p.get(int(lengths[i]), 0) + 1
                if (key := tuple(sorted(p.items()))) not in seen:
                    seen.add(key)
                    entered += master.enter(p, 1.0)
                    if entered >= columns:
                        break
            if share == 0:
                break
            share = share / 2 if share > 0.1 else 0.0
        rounds += 1
        marks.append(master.value())
        if not entered:  # priced at the program's own dual prices
            best = 1.0
            break
    left = {int(l): int(histogram[int(l)]) for l in lengths}
    out: list[Pattern] = []
    x = master.x * master.cost

    def take(c: dict[int, int], n: int) -> None:
        n = min([n, *(left[l] // k for l, k in c.items())])
        if n > 0:
            out.append((c, n))
            for l, k in c.items():
                left[l] -= k * n

    for c, n in zip(master.columns, np.floor(x + 1e-7).astype(np.int64).tolist()):
        if n:
            take(c, n)
    for j in np.argsort(np.floor(x + 1e-7) - x, kind="stable").tolist():
        if master.cost[j] and x[j] % 1 > 0.25:
            take(master.columns[j], 1)
    out += greedy(left, capacity)
    shorter = out if sum(n for _, n in out) <= sum(n for _, n in plain) else plain
    return Solution(shorter, master.value(), bound, rounds, best)


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, part and local_rank (its place among the pieces of
    its length that the task cut); with_ids adds the ids."""

    def run(batches):
        from pyspark import TaskContext

        part, encoder, end = TaskContext.get().partitionId(), encoder_of(tokenizer), array("I", [end_id]).tobytes()
        ranks = np.zeros(capacity + 1, np.int64)
        width = 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                row, start, length, crc, total, rank, kept = [], [], [], [], [], [], []
                for i, text in enumerate(piece.column("text").to_pylist()):
                    ids = encoder.encode(text) + end
                    for a in range(0, len(ids), width):
                        b = min(a + width, len(ids))
                        n = (b - a) // 4
                        row.append(i)
                        start.append(a // 4)
                        length.append(n)
                        crc.append(zlib.crc32(ids[a:b]))
                        total.append(len(ids) // 4)
                        rank.append(ranks[n])
                        ranks[n] += 1
                        if with_ids:
                            kept.append(np.frombuffer(ids[a:b], np.int32))
                columns = [piece.column("doc_id").take(pa.array(row, pa.int32()))]
                columns += [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
                columns += [pa.array(np.full(len(row), part, np.int32)), pa.array(np.array(rank, np.int64))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local_rank"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_rank long" + ", ids array<int>" * with_ids
    return small_batches(texts_of(docs)).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, with_ids: bool = False, gap: float = 0.0002) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of each piece. See the module."""
    pieces = cut(cut_documents(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.where(F.col("length") < capacity).groupBy("length").agg(F.sum("n").alias("n")).collect()}  # fewer than capacity rows
    patterns = solve_patterns(histogram, capacity, gap).patterns

    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # length: first rank, pieces a sequence, first sequence, offset
    taken: dict[int, int] = {}
    sequences = 0
    for pattern, times in patterns:
        offset = 0
        for l in sorted(pattern, reverse=True):
            slots.setdefault(l, []).append((taken.get(l, 0), pattern[l], sequences, offset))
            taken[l] = taken.get(l, 0) + pattern[l] * times
            offset += pattern[l] * l
        sequences += times
    slots[capacity] = [(0, 1, sequences, 0)]
    tables = {l: np.array(s, np.int64).T for l, s in slots.items()}

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("local_rank").to_numpy(zero_copy_only=False) + batch.column("before").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                l = int(length[rows[0]])
                first, each, base, off = tables[l]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                within = rank[rows] - first[k]
                sequence[rows] = base[k] + within // each[k]
                offset[rows] = off[k] + within % each[k] * l
            names = [n for n in batch.schema.names if n not in ("part", "local_rank", "before")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    joined = pieces.join(counts.select("part", "length", "before").hint("shuffle_hash"), ["part", "length"])  # grows with the tasks: not broadcast
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "local_rank", "before"]
    return joined.select(*names).mapInArrow(place, schema)


def sequences_of(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id and ids, from pieces packed with_ids; a sequence holds at most its capacity of ids."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return rows.select("sequence_id", F.flatten(F.col("x.ids")).alias("ids"))
