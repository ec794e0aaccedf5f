"""SentencePiece encoding by the rules of the model file's type.

A merge (BPE) model joins, from single characters on, the two neighbours whose piece has the greatest score, of equal ones
the leftmost, until no neighbours form a piece; an unknown character becomes its bytes. No merge crosses two characters
that stand side by side in no piece. A text is divided there, so a part met again is remembered, and a document of
more than `giant` characters is cut there into chunks that tasks solve apart, with the ids of the whole. A run without
such a place stays in one chunk, in time n log n.

Unigram models go by the scan in sufloom.llm.pieces; other types are an error. Defined results: as there.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sufloom.llm import pieces
from sufloom.llm.common import Remembered, cut, slices, small_batches
from sufloom.llm.pieces import IDS, MARK, NEVER, pieces_of
from sufloom.llm.token_output import texts_of


def fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message: an int, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            x = raw[at]
            at += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, raw[at : at + size]
            at += size


BPE, USER_DEFINED, UNUSED = 2, 4, 5  # of the model file: trainer_spec.model_type, pieces.type


def is_merges(path: str) -> bool:
    """Whether the model file is a merge (BPE) model; other types than this and unigram are an error."""
    with open(path, "rb") as f:
        raw = f.read()
    kind = next((v for n, spec in fields(raw) if n == 2 for m, v in fields(spec) if m == 3), 1)
    if kind not in (1, BPE):
        raise ValueError(f"{path}: neither a unigram nor a BPE model")
    if kind == BPE and any(n == 3 and v in (USER_DEFINED, UNUSED) for m, piece in fields(raw) if m == 1 for n, v in fields(piece)):
        raise ValueError(f"{path}: user-defined and unused pieces of BPE models are not supported")
    return kind == BPE


class Merges:
    """A merge model's pieces."""

    def __init__(self, path: str, most: int = 50 << 20):
        own = pieces_of(path)
        self.table, self.spelt, self.normalize, self.words_apart = own.table, own.spelt, own.normalize, own.words_apart
        if len(own.byte_id) < 256:
            raise ValueError(f"{path}: BPE models without byte pieces are not supported")
        self.joins, self._parts = own.joins, own.parts
        self._merged = Remembered(lambda word: np.array(self.merge(word), "<i4").tobytes(), most)

    def merge(self, word: str) -> list[int]:
        """Ids of a text under the merge rules; short ones without an agenda."""
        symbols: list[str] = list(word)
        n = len(symbols)
        get, agenda = self.table.get, []
        if n <= 64:
            none = (NEVER, -1)
            scores = [get(a + b, none)[0] for a, b in zip(symbols, symbols[1:])]
            while scores and (best := max(scores)) > NEVER:
                i = scores.index(best)
                symbols[i] += symbols.pop(i + 1)
                del scores[i]
                if i < len(scores):
                    scores[i] = get(symbols[i] + symbols[i + 1], none)[0]
                if i:
                    scores[i - 1] = get(symbols[i - 1] + symbols[i], none)[0]
            return self.ids_of(symbols)
        for i in range(n - 1):
            if found := get(symbols[i] + symbols[i + 1]):
                agenda.append((-found[0], i, i + 1, 2))
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := get(symbols[i] + symbols[k]):
                    heapq.heappush(agenda, (-found[0], i, k, size + len(symbols[k])))
            h = before[i]
            if h >= 0 and (found := get(symbols[h] + symbols[i])):
                heapq.heappush(agenda, (-found[0], h, i, len(symbols[h]) + size))
        return self.ids_of([x for x in symbols if x])

    def ids_of(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for x in symbols:
            found = self.table.get(x)
            if found:
                out.append(found[1])
            else:
                out += self.spelt(x)
        return out

    def merged(self, text: str) -> bytes:
        """Ids of a normalized text, or of a chunk of one, as little-endian 32-bit integers."""
        return b"".join(map(self._merged.__getitem__, self._parts.findall(text)))

    def chunks(self, text: str, size: int):
        """The normalized text in parts of `size` characters and as many more as it takes to a place that no piece spans."""
        at = 0
        while at < len(text):
            end = at + size
            while end < len(text) and text[end - 1 : end + 1] in self.joins:
                end += 1
            yield text[at:end]
            at = end

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.merged(self.normalize(text)), "<i4").tolist()


def merges_of(path: str) -> Merges:
    """One table for each Python process, kept with the model's pieces, which decoding also takes."""
    own = pieces_of(path)
    if own.merges is None:
        own.merges = Merges(path)
    return own.merges


def merged_lists(own: Merges, texts: list[str]) -> pa.Array:
    return pieces.packed_lists([own.merged(t) for t in texts])


def encode_merges(docs: DataFrame, model: str, giant: int, chunk: int) -> DataFrame:
    """doc_id and ids of each row of docs (doc_id, text), by a merge model."""
    rows = small_batches(texts_of(docs))
    small = rows.where(F.col("text").isNull() | (F.length("text") <= giant))

    def run(batches):
        own = merges_of(model)
        for part in slices(batches, 500):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), merged_lists(own, [own.normalize(t) for t in part.column("text").to_pylist()])], names=["doc_id", "ids"])

    def chunks(batches):
        own = merges_of(model)
        for part in slices(batches, 1):
            for k, piece in enumerate(own.chunks(own.normalize(part.column("text")[0].as_py()), chunk)):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array([k], pa.int32()), pa.array([piece])], names=["doc_id", "row", "k", "piece"])

    def solve(batches):
        own = merges_of(model)
        for part in slices(batches, 500):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), part.column("k"), merged_lists(own, part.column("piece").to_pylist())], names=["doc_id", "row", "k", "ids"])

    large = rows.where(F.length("text") > giant).withColumn("row", F.monotonically_increasing_id())
    cuts = cut(large.mapInArrow(chunks, "doc_id long, row long, k int, piece string"), "chunks")
    solved = cuts.repartition("row", "k").mapInArrow(solve, "doc_id long, row long, k int, ids array<int>")
    joined = solved.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x")).select("doc_id", F.flatten("x.ids").alias("ids"))
    return small.mapInArrow(run, IDS).unionByName(joined)


def encode(docs: DataFrame, model: str, giant: int = 32_768, chunk: int = 8_192) -> DataFrame:
    """doc_id and ids of each row of docs (doc_id, text), by the model file's type."""
    return (encode_merges if is_merges(model) else pieces.encode)(docs, model, giant, chunk)
