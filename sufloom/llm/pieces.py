"""SentencePiece encoding and decoding: the segmentation of greatest total score, by a max-plus parallel scan.

Encoding follows the unigram rules over a model file's pieces and scores, whatever its type: the best path over all pieces, an unknown
character at the least score minus 10 and then as its bytes. In a model whose pieces
hold the space mark only at their start, paths restart at each word, and in it between characters that stand side by side in
no piece; a part between such places is solved once and remembered. A merge
(BPE) file's own segmentation is another one: see sufloom.llm.merges, whose encode() follows the file's type.

A document of more than `giant` characters is split, in one pass, into chunks of `chunk` characters (to the next word start
where words are apart, so ties among equal paths are settled as in a whole text; otherwise of equal states at a boundary
the one that reaches least into the next chunk is taken), which tasks solve apart: for each
number of characters that a piece begun before may reach into the chunk, and each number that the chunk's last piece may
reach beyond it, the best score between (the transfer matrix, max-plus). Max-plus products of the matrices, which is
associative, span many chunks at once and give the scores at the boundaries; from these follows the state at each
boundary, and each chunk is backtraced on its own between its two states.

Defined results: a null or empty text has no ids. Repeated rows come back as often as they came. An empty table gives no
rows. Other columns are ignored. A text in which U+2581 stands decodes with a space in its place.
"""

from __future__ import annotations

import functools
import re
import zlib
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sufloom.llm.common import Remembered, cut, held, slices, small_batches
from sufloom.llm.token_output import texts_of

MARK = "▁"
NEVER = -np.inf


class Pieces:
    """A model file's pieces as the tables that the scan needs."""

    def __init__(self, path: str, most: int = 50 << 20):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(n)]
        self.bytes_of = [b""] * n
        self.byte_id: dict[int, int] = {}
        normal = []
        for i, p in enumerate(text):
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append(i)
                self.bytes_of[i] = p.replace(MARK, " ").encode()
        scores = {i: float(model.get_score(i)) for i in normal}
        self.unknown = min(scores.values()) - 10
        self.table = {text[i]: (scores[i], i) for i in normal}
        self.width = max(map(len, self.table))
        self.unk = model.unk_id()
        self.words_apart = not any(MARK in p.lstrip(MARK) for p in self.table)
        self.heads = {p[:i]: None for p in self.table for i in range(1, len(p))} | self.table  # beginnings of pieces, too
        longer = [p for p in self.table if len(p) > 1]
        self.joins = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        self.parts = self._cuts() if self.words_apart else re.compile("(?s:.+)")
        self._known = Remembered(self._solved, most // 2)  # an entry takes about twice the estimate
        self.merges = None  # of sufloom.llm.merges
        self.both = None  # of sufloom.llm.segments

    def _cuts(self) -> re.Pattern:
        """Parts of a text between whose characters no piece stands, so that all paths meet there: characters that join
        none, and the places where a mark follows another character."""
        alone = re.escape("".join(c for c in map(chr, range(128)) if not any(c in j for j in self.joins)))
        marks = set(punctuation)  # closed under what pieces have before them; the rest never joins one, and parts end there
        while more := {j[0] for j in self.joins if j[1] in marks} - marks - {MARK}:
            marks |= more
        marks = re.escape("".join(sorted(marks))) if not any(c.isascii() and c.isalpha() for c in marks) else ""
        words = (f"{MARK}*[{marks}]*[^{MARK}{alone}{marks}]+|{MARK}*[{marks}]+" if marks else f"{MARK}*[^{MARK}{alone}]+") + f"|{MARK}+"
        return re.compile(f"{f'[{alone}]|' if alone else ''}{words}")

    def _solved(self, part: str) -> tuple[float, bytes]:
        total, ids = self.path_between(part, 0, len(part))
        return total, np.array(ids, "<i4").tobytes()

    def normalize(self, text: str | None) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def ids_between(self, text: str, start: int, end: int) -> list[int]:
        """Ids of the best path over text[start:end], word by word where words are apart."""
        starts = [m.start() for m in _START.finditer(text, start, end) if m.start() > start] if self.words_apart else []
        if not starts:
            return self.path_between(text, start, end)[1]
        out = list(self.path_between(text, start, starts[0])[1])
        out += np.frombuffer(self.solved(text[starts[0] : starts[-1]]), "<i4").tolist()
        return out + self.path_between(text, starts[-1], end)[1]

    def solved(self, text: str) -> bytes:
        """Ids of the best path over whole words, as little-endian 32-bit integers, part by part, each remembered."""
        return b"".join([x[1] for x in map(self._known.__getitem__, self.parts.findall(text))])

    def path_between(self, text: str, start: int, end: int) -> tuple[float, list[int]]:
        """Score and ids of the best path over text[start:end]; of equal paths, the one whose last pieces are longest."""
        n = end - start
        best, last = [0.0] + [NEVER] * n, [0] * (n + 1)
        kind = [-1] * (n + 1)
        get, width, unknown = self.heads.get, self.width, self.unknown
        for a in range(n):
            base, single = best[a], False
            for b in range(a + 1, min(n, a + width) + 1):
                found = get(text[start + a : start + b], ())
                if found == ():  # no piece begins so
                    break
                if found:
                    single |= b == a + 1
                    s = base + found[0]
                    if s > best[b]:
                        best[b], last[b], kind[b] = s, a, found[1]
            if not single and base + unknown > best[a + 1]:
                best[a + 1], last[a + 1], kind[a + 1] = base + unknown, a, -1
        out: list[list[int]] = []
        b = n
        while b:
            a = last[b]
            out.append([kind[b]] if kind[b] >= 0 else self.spelt(text[start + a]))
            b = a
        return best[n], [i for x in reversed(out) for i in x]

    def spelt(self, char: str) -> list[int]:
        return [self.byte_id.get(x, self.unk) for x in char.encode()] if self.byte_id else [self.unk]

    def encoded(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        whole = self.normalize(text)
        return self.solved(whole) if self.words_apart else np.array(self.ids_between(whole, 0, len(whole)), "<i4").tobytes()

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encoded(text), "<i4").tolist()

    def transfer(self, text: str, n: int) -> np.ndarray:
        """Transfer matrix of the chunk text[:n]; text goes on for up to width - 1 characters beyond it. Where words are
        apart, all paths meet at the chunk's first and last word start, and the matrix is a sum of two vectors."""
        starts = [m.start() for m in _START.finditer(text, 0, n)] if self.words_apart else []
        if not starts:
            return self.between(text, n)
        first, last = starts[0], starts[-1]
        head = self.between(text[:first], first)[:, 0]
        middle = sum(self._known[w][0] for w in self.parts.findall(text[first:last]))
        return head[:, None] + middle + self.between(text[last:], n - last)[0][None, :]

    def between(self, text: str, n: int) -> np.ndarray:
        """transfer() by way of all positions."""
        w = self.width
        best = np.full((n + w, w), NEVER)  # best[e, i]: path from position i to position e
        best[np.arange(min(w, n + w)), np.arange(min(w, n + w))] = 0
        get = self.table.get
        for a in range(n):
            row, single = best[a], False
            for b in range(a + 1, min(len(text), a + w) + 1):
                found = get(text[a:b])
                if found:
                    single |= b == a + 1
                    np.maximum(best[b], row + found[0], out=best[b])
            if not single:
                np.maximum(best[a + 1], row + self.unknown, out=best[a + 1])
        out = best[n : n + w].T.copy()  # from state i to state j
        for i in range(n + 1, w):  # a piece that reaches over the whole chunk
            out[i] = NEVER
            out[i, i - n] = 0
        return out

    def chunks(self, text: str, size: int):
        """(begin, end) of parts of `size` characters of a normalized text, where words are apart of as many more as it
        takes to the next word start: there no path crosses, so ties are settled as in the whole text."""
        at = 0
        while at < len(text):
            end = min(len(text), at + size)
            if self.words_apart and end < len(text):
                m = _START.search(text, end)
                end = m.start() if m else len(text)
            yield at, end
            at = end

    def decode(self, ids: np.ndarray) -> str:
        some = (ids[at : at + 65_536].tolist() for at in range(0, len(ids), 65_536))
        raw = b"".join([b"".join([self.bytes_of[i] for i in x]) for x in some]).decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw


_START = re.compile(f"(?<=[^{MARK}]){MARK}")


def pieces_of(path: str) -> Pieces:
    """One table for each Python process."""
    return held(("pieces", path), lambda: Pieces(path))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def boundary_states(matrices: list[np.ndarray], span: int = 32) -> list[int]:
    """The state at each boundary of the best path from state 0 to state 0, found over products of spans of matrices."""
    if len(matrices) == 1:
        return [0, 0]

    def between(ms: list[np.ndarray], first: int, last: int) -> list[int]:
        if len(ms) > span:
            groups = [ms[i : i + span] for i in range(0, len(ms), span)]
            outer = between([functools.reduce(product, g) for g in groups], first, last)
            inner = [between(g, a, b) for g, a, b in zip(groups, outer[:-1], outer[1:])]
            return [first, *(s for x in inner for s in x[1:])]
        forward = [np.full(len(ms[0]), NEVER)]
        forward[0][first] = 0
        for m in ms:
            forward.append((forward[-1][:, None] + m).max(axis=0))
        states = [last]
        for f, m in zip(forward[-2::-1], ms[::-1]):
            states.append(int((f + m[:, states[-1]]).argmax()))
        return states[::-1]

    return between(matrices, 0, 0)


IDS = "doc_id long, ids array<int>"


def packed_lists(rows: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def id_lists(rows: list[list[int]]) -> pa.Array:
    lens = np.array([len(r) for r in rows], np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(np.array([i for r in rows for i in r], np.int32)))


def encode(docs: DataFrame, model: str, giant: int = 32_768, chunk: int = 8_192) -> DataFrame:
    """doc_id and ids of each row of docs (doc_id, text)."""
    rows = small_batches(texts_of(docs))
    small = rows.where(F.col("text").isNull() | (F.length("text") <= giant))

    def run(batches):
        own = pieces_of(model)
        for part in slices(batches, 500):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed_lists([own.encoded(t) for t in part.column("text").to_pylist()])], names=["doc_id", "ids"])

    def chunks(batches):
        own = pieces_of(model)
        for part in slices(batches, 1):
            whole = own.normalize(part.column("text")[0].as_py())
            for k, (a, b) in enumerate(own.chunks(whole, chunk)):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array([k], pa.int32()), pa.array([b - a], pa.int32()), pa.array([whole[a : b + own.width]])], names=["doc_id", "row", "k", "size", "piece"])

    large = rows.where(F.length("text") > giant).withColumn("row", F.monotonically_increasing_id())
    pieces = cut(large.mapInArrow(chunks, "doc_id long, row long, k int, size int, piece string"), "chunks")

    def matrices(batches):
        own = pieces_of(model)
        for batch in slices(batches, 100):
            for r in batch.select(["row", "k", "size", "piece"]).to_pylist():
                m = own.transfer(r["piece"], r["size"]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([r["row"]]), pa.array([r["k"]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(m)], pa.int32()), pa.array(m))], names=["row", "k", "m"])

    # One row for each chunk, of width^2 numbers: for the longest text that a row holds some tens of megabytes.
    solved = pieces.repartition("row", "k").mapInArrow(matrices, "row long, k int, m array<double>")

    def states(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        flat = table["m"].combine_chunks().flatten().to_numpy()
        w = int((len(flat) // table.num_rows) ** 0.5)
        ms = list(flat.reshape(-1, w, w))
        s = boundary_states(ms)
        return pa.table({"row": table["row"], "k": table["k"], "first": pa.array(s[:-1], pa.int32()), "last": pa.array(s[1:], pa.int32())})

    bounds = solved.groupBy("row").applyInArrow(states, "row long, k int, first int, last int")

    def backtrace(batches):
        own = pieces_of(model)
        for batch in slices(batches, 100):
            c = batch.to_pydict()
            ids = [own.ids_between(p, a, max(a, s + b)) for p, s, a, b in zip(c["piece"], c["size"], c["first"], c["last"])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("k"), id_lists(ids)], names=["doc_id", "row", "k", "ids"])

    traced = pieces.join(bounds, ["row", "k"]).select("doc_id", "row", "k", "size", "piece", "first", "last").mapInArrow(backtrace, "doc_id long, row long, k int, ids array<int>")
    joined = traced.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x")).select("doc_id", F.flatten("x.ids").alias("ids"))
    return small.mapInArrow(run, IDS).unionByName(joined)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and text of each row of (doc_id, ids)."""

    def run(batches):
        own = pieces_of(model)
        for batch in slices(batches, 500):
            ids = batch.column("ids")
            ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            texts = pa.array([own.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, texts], names=["doc_id", "ids", "text"])

    return encoded.mapInArrow(run, IDS + ", text string")


def digests(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_crc32 (of the decoded text as UTF-8)."""

    def run(batches):
        own = pieces_of(model)
        for batch in slices(batches, 500):
            ids = batch.column("ids")
            lens = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lens)])
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            text = [zlib.crc32(own.decode(flat[a:b]).encode()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lens), pa.array(crc, pa.int64()), pa.array(text, pa.int64())], names=["doc_id", "n_tokens", "ids_crc32", "decoded_crc32"])

    return small_batches(encoded).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long")
