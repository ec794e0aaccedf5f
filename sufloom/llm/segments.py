"""Both segmentations of each text by a merge model in one pass: the file's own merges (sufloom.llm.merges), and the path of
greatest total score (sufloom.llm.pieces).

A text is divided where no piece spans, which holds for both. The parts of many texts that aren't remembered are solved
together, arrays over thousands of them: the scan in steps over places (max-plus: a place's best score from those of the
places before it), the merges in rounds (each joins the best neighbours of every part that still has any). Parts of more than
LONGEST characters, or with a character that is no piece, are solved one at a time by the two modules.

A document of more than `giant` characters is cut where no piece spans into chunks that tasks solve apart; each gives its
merges, its transfer matrix, and the scan's ids between its first and its last part, which are the same from any
state. Products of the matrices give the states at the boundaries, and with them the ids of first and last parts follow.

Where pieces cross word starts, or the file isn't a merge model, the two are made apart: joined() in sufloom.llm.op2. Defined
results: as in those modules.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sufloom.llm.common import cut, slices, small_batches
from sufloom.llm.merges import Merges, merges_of
from sufloom.llm.pieces import NEVER, Pieces, boundary_states, packed_lists, pieces_of
from sufloom.llm.token_output import texts_of

LONGEST = 64
BLOCK = 1 << 16  # characters solved at once
ENTRY = 330  # bytes that a remembered part takes, about, besides its characters and ids


class Lookup:
    """A hash table from whole numbers (0 or more) to numbers, for arrays of keys; -1 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(62 - len(keys).bit_length())
        size = 1 << (64 - int(self.shift))
        self.last, self.keys, self.values = size - 1, np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.last
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class Parts:
    """Both segmentations of the parts of texts, remembered by number: `merged`, `scanned` (ids as little-endian 32-bit
    integers) and `total` (the scan's score). Of more than `most` bytes by an estimate the parts met least are forgotten."""

    def __init__(self, own: Pieces, merges: Merges, most: int = 100 << 20):
        self.own, self.merges, self.most = own, merges, most
        self._tables()
        self.number = _Numbers()
        self.merged: list[bytes] = []
        self.scanned: list[bytes] = []
        self.total: list[float] = []
        self.times = np.zeros(0, np.int64)
        self.used = 0

    def _tables(self) -> None:
        table, heads = self.own.table, self.own.heads
        node = {p: n for n, p in enumerate(heads)}
        chars = sorted({c for p in table for c in p})
        self.width = len(chars) + 1  # code 0: in no piece, or beyond a part's end
        code = {c: n for n, c in enumerate(chars, 1)}
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, self.width)
        self.first = np.full(self.width, -1, np.int32)
        self.first[[code[p] for p in heads if len(p) == 1]] = [node[p] for p in heads if len(p) == 1]
        longer = [p for p in heads if len(p) > 1]
        self.step = Lookup(np.array([node[p[:-1]] * self.width + code[p[-1]] for p in longer], np.int64), np.array([node[p] for p in longer], np.int32))
        self.inner = np.zeros(len(heads) + 1, bool)  # of a node: whether longer ones begin so; the last entry is for -1, here and below
        self.inner[[node[p[:-1]] for p in longer]] = True
        self.score = np.array([*(x[0] if x else NEVER for x in heads.values()), NEVER])
        self.piece = np.array([*(x[1] if x else -1 for x in heads.values()), -1], np.int64)
        self.none = int(self.piece.max()) + 1  # stands where a part has no id
        pairs = [(table[p[:i]][1] * (self.none + 1) + table[p[i:]][1], *table[p]) for p in table for i in range(1, len(p)) if p[:i] in table and p[i:] in table]
        self.pair = Lookup(np.array([x[0] for x in pairs], np.int64), np.arange(len(pairs), dtype=np.int32))
        self.pair_score = np.array([*(x[1] for x in pairs), NEVER])
        self.pair_piece = np.array([x[2] for x in pairs], np.int64)

    def numbers_of(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the parts of each normalized text; valid up to the next call."""
        if self.used > self.most:
            self._forget()
        number, parts = self.number.__getitem__, self.own.parts.findall
        found = [list(map(number, parts(t))) for t in texts]
        if new := self.number.new:
            self.number.new = []
            merged, scanned, total = self.solve(new)
            self.merged += merged
            self.scanned += scanned
            self.total += total
            self.used += sum(ENTRY + 2 * len(p) + len(m) + len(s) for p, m, s in zip(new, merged, scanned))
            self.times = np.concatenate([self.times, np.zeros(len(new), np.int64)])
        self.times += np.bincount(np.fromiter(itertools.chain.from_iterable(found), np.int64), minlength=len(self.times))
        return found

    def _forget(self) -> None:
        names = list(self.number)
        kept = np.argsort(-self.times, kind="stable")[: len(names) // 2]
        kept = [n for n in kept.tolist() if len(names[n]) <= LONGEST]
        self.number = _Numbers({names[n]: k for k, n in enumerate(kept)})
        self.merged, self.scanned, self.total = [self.merged[n] for n in kept], [self.scanned[n] for n in kept], [self.total[n] for n in kept]
        self.times = self.times[kept] // 2
        self.used = sum(ENTRY + 2 * len(p) + len(m) + len(s) for p, m, s in zip(self.number, self.merged, self.scanned))

    def encoded(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text by the merges, and by the scan."""
        found = self.numbers_of([self.own.normalize(t) for t in texts])
        return [b"".join(map(self.merged.__getitem__, f)) for f in found], [b"".join(map(self.scanned.__getitem__, f)) for f in found]

    def solve(self, parts: list[str]) -> tuple[list[bytes], list[bytes], list[float]]:
        """Merges, scan and its score of each part."""
        n = len(parts)
        merged, scanned, total = [b""] * n, [b""] * n, [0.0] * n
        lens = np.fromiter(map(len, parts), np.int64, n)
        starts = np.cumsum(lens) - lens
        codes = self.code[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")]
        plain = np.logical_and.reduceat(self.piece[self.first[codes]] >= 0, starts) & (lens <= LONGEST)
        for i in np.flatnonzero(~plain).tolist():
            total[i], ids = self.own.path_between(parts[i], 0, len(parts[i]))
            scanned[i], merged[i] = np.array(ids, "<i4").tobytes(), np.array(self.merges.merge(parts[i]), "<i4").tobytes()
        order = np.flatnonzero(plain)
        order = order[np.argsort(lens[order], kind="stable")]
        while len(order):
            size = max(1, BLOCK // int(lens[order[min(len(order), BLOCK // int(lens[order[0]])) - 1]]))
            block, order = order[:size], order[size:]
            n = lens[block]
            places = np.arange(n.max())
            inside = places < n[:, None]
            own = np.where(inside, codes[np.where(inside, starts[block][:, None] + places, 0)], 0)
            best, paths = self.scan(np.ascontiguousarray(own.T), n)
            joined = self.join(np.where(inside, self.piece[self.first[own]], self.none))
            for i, b, s, m in zip(block.tolist(), best.tolist(), self._rows(paths), self._rows(joined)):
                total[i], scanned[i], merged[i] = b, s, s if s == m else m
        return merged, scanned, total

    def _rows(self, ids: np.ndarray):
        there = ids != self.none
        flat = ids[there].astype("<i4").tobytes()
        ends = [0, *(4 * np.cumsum(there.sum(axis=1))).tolist()]
        return (flat[a:b] for a, b in zip(ends, ends[1:]))

    def scan(self, codes: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the best paths of many parts, a column of character codes each, and their ids, a row each; of equal
        paths, the one whose last pieces are longest."""
        most, n = codes.shape
        nodes = [self.first[codes]]  # nodes[l - 1][a]: of the l characters from a on
        while len(nodes) < most:
            before, after = nodes[-1][:-1].ravel(), codes[len(nodes) :].ravel()
            alive = np.flatnonzero(self.inner[before])
            if not len(alive):
                break
            own = np.full(before.shape, -1, np.int32)
            own[alive] = self.step(before[alive].astype(np.int64) * self.width + after[alive])
            nodes.append(own.reshape(-1, n))
        scores = [self.score[x] for x in nodes]
        best, last = np.full((most + 1, n), NEVER), np.ones((most + 1, n), np.int64)
        best[0] = 0
        for b in range(1, most + 1):
            best[b] = best[b - 1] + scores[0][b - 1]
            for length in range(2, min(b, len(nodes)) + 1):
                s = best[b - length] + scores[length - 1][b - length]
                better = s >= best[b]
                np.copyto(best[b], s, where=better)
                np.copyto(last[b], length, where=better)
        ids = np.full((n, most), self.none)
        ends, rows, at = lens.copy(), np.arange(n), most
        flat = np.concatenate([x.ravel() for x in nodes])
        begin = np.cumsum([0, *(x.size for x in nodes)])
        while len(rows):
            at -= 1
            length = last[ends, rows]
            ends = ends - length
            ids[rows, at] = self.piece[flat[begin[length - 1] + ends * n + rows]]
            rows, ends = rows[ends > 0], ends[ends > 0]
        return best[lens, np.arange(n)], ids

    def join(self, ids: np.ndarray) -> np.ndarray:
        """Ids of many parts, a row each, after all merges: in each round every row joins its neighbours of the greatest
        score, of equal ones the leftmost. Places that fall free hold `none`, and so do those beyond a part's end."""
        out, rows, base = np.full(ids.shape, self.none), np.arange(len(ids)), self.none + 1
        scores = self.pair_score[self.pair((ids[:, :-1] * base + ids[:, 1:]).ravel())].reshape(len(ids), -1)
        while scores.shape[1]:
            i = scores.argmax(axis=1)
            on = scores[np.arange(len(i)), i] > NEVER
            out[rows[~on], : ids.shape[1]] = ids[~on]
            ids, scores, rows, i = ids[on], scores[on], rows[on], i[on]
            if not len(rows):
                return out
            k = np.arange(len(i))
            ids[k, i] = self.pair_piece[self.pair(ids[k, i] * base + ids[k, i + 1])]
            ids = ids[np.arange(ids.shape[1]) != (i + 1)[:, None]].reshape(len(i), -1)
            scores = scores[np.arange(scores.shape[1]) != i[:, None]].reshape(len(i), -1)
            for j, some in ((i, i < scores.shape[1]), (i - 1, i > 0)):
                j, r = j[some], k[some]
                scores[r, j] = self.pair_score[self.pair(ids[r, j] * base + ids[r, j + 1])]
        out[rows, : ids.shape[1]] = ids
        return out


class _Numbers(dict):
    """Numbers of parts in the order they are met; those met since `new` was emptied are in it."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self.new.append(part)
        n = self[part] = len(self)
        return n


def parts_of(path: str) -> Parts:
    """One table for each Python process, kept with the model's pieces."""
    own = pieces_of(path)
    if own.both is None:
        own.both = Parts(own, merges_of(path))
    return own.both


IDS = "doc_id long, ids array<int>, scan_ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, scan_tokens long, scan_crc32 long"


def id_rows(own: Pieces, doc_ids, merged: list[bytes], scanned: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids, packed_lists(merged), packed_lists(scanned)], names=["doc_id", "ids", "scan_ids"])


def digest_rows(own: Pieces, doc_ids, merged: list[bytes], scanned: list[bytes]) -> pa.RecordBatch:
    """As digests() in sufloom.llm.pieces has them, where the ids are made."""
    decoded = [zlib.crc32(own.decode(np.frombuffer(x, "<i4")).encode()) for x in merged]
    columns = [[len(x) // 4 for x in merged], [zlib.crc32(x) for x in merged], decoded, [len(x) // 4 for x in scanned], [zlib.crc32(x) for x in scanned]]
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "scan_tokens", "scan_crc32"])


def encode(docs: DataFrame, model: str, giant: int = 32_768, chunk: int = 8_192, digest: bool = False) -> DataFrame:
    """doc_id, ids (by the merges) and scan_ids of each row of docs (doc_id, text); with `digest`, counts and checksums of them."""
    rows = small_batches(texts_of(docs))
    small = rows.where(F.col("text").isNull() | (F.length("text") <= giant))
    made, schema = (digest_rows, DIGESTS) if digest else (id_rows, IDS)

    def run(batches):
        own = parts_of(model)
        for part in slices(batches, 250):
            yield made(own.own, part.column("doc_id"), *own.encoded(part.column("text").to_pylist()))

    def chunks(batches):
        own = merges_of(model)
        for part in slices(batches, 1):
            for k, piece in enumerate(own.chunks(own.normalize(part.column("text")[0].as_py()), chunk)):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array([k], pa.int32()), pa.array([piece])], names=["doc_id", "row", "k", "piece"])

    large = rows.where(F.length("text") > giant).withColumn("row", F.monotonically_increasing_id())
    pieces = cut(large.mapInArrow(chunks, "doc_id long, row long, k int, piece string"), "chunks")

    def solve(batches):
        own = parts_of(model)
        for batch in slices(batches, 50):
            texts = batch.column("piece").to_pylist()
            found = own.numbers_of(texts)
            merged = [b"".join([own.merged[n] for n in f]) for f in found]
            middle = [b"".join([own.scanned[n] for n in f[1:-1]]) for f in found]
            ends = [(x[0], x[-1] if len(x) > 1 else "") for x in map(own.own.parts.findall, texts)]
            m = [between_ends(own.own, a, sum([own.total[n] for n in f[1:-1]]), b).ravel() for (a, b), f in zip(ends, found)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, m)]), pa.int32()), pa.array(np.concatenate(m)))
            columns = [batch.column(c) for c in ("doc_id", "row", "k")] + [packed_lists(merged), packed_lists(middle), pa.array([a for a, _ in ends], pa.string()), pa.array([b for _, b in ends], pa.string()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "k", "merged", "middle", "head", "tail", "m"])

    solved = pieces.repartition("row", "k").mapInArrow(solve, "doc_id long, row long, k int, merged array<int>, middle array<int>, head string, tail string, m array<double>")

    def trace(table: pa.Table) -> pa.Table:
        own, order = pieces_of(model), np.argsort(table["k"].to_numpy()).tolist()
        numbers = lambda column, i: table[column][i].values.to_numpy()
        states = boundary_states([numbers("m", i).reshape(own.width, own.width) for i in order])
        scanned = []
        for i, a, b in zip(order, states, states[1:]):
            head, tail = table["head"][i].as_py(), table["tail"][i].as_py()
            scanned += [np.array(own.path_between(head, a, len(head))[1], "<i4").tobytes(), numbers("middle", i).astype("<i4").tobytes()]
            scanned.append(np.array(own.path_between(tail, 0, len(tail) + b)[1], "<i4").tobytes())
        merged = b"".join([numbers("merged", i).astype("<i4").tobytes() for i in order])
        return pa.Table.from_batches([made(own, table["doc_id"].slice(0, 1).combine_chunks(), [merged], [b"".join(scanned)])])

    # A document's chunks meet as what its one row of ids is made of; the words at their ends are all that is solved there.
    return small.mapInArrow(run, schema).unionByName(solved.groupBy("row").applyInArrow(trace, schema))


def between_ends(own: Pieces, head: str, middle: float, tail: str) -> np.ndarray:
    """The transfer matrix of a chunk of whole parts, given its first and last and the score between them: as all paths
    meet at the parts' ends, a sum of two vectors."""
    if not tail:
        return own.between(head, len(head))
    return own.between(head, len(head))[:, :1] + middle + own.between(tail, len(tail))[:1]
