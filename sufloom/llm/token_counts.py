"""Token counts of many texts without their ids: pieces are counted once for each distinct pre-token.

A tokenizer of the tokenizers library normalizes a text, splits it into pre-tokens and cuts each of those into pieces on
its own, so a text's token count is the sum over its distinct pre-tokens of frequency times pieces.

    documents -> (row, {pre-token: frequency})           one pass over the texts, in Python
    distinct pre-tokens -> pieces                         the library's model, once for each of them
    frequencies joined to pieces, summed by row

The join has two parts. The `frequent` pre-tokens found in most documents of a bounded sample (`sample` documents with the
least hashes) form a table of at most `frequent` rows of at most LONGEST characters: it is broadcast, and their share of a
row's sum is taken where the row is split. No other pre-token is in a large part of the rows; those are written to the
shared folder as lists, grouped for their pieces and joined by shuffle. The sample decides which way a pre-token takes and
nothing else: counts are the same with any.

Defined results: a null or empty text has 0 bytes and 0 tokens. Strings of added tokens inside a text count as one token
each, as the library takes them by default. Repeated rows and null ids are counted row by row. An empty table gives no
rows. A text of any length is split whole; its distinct pre-tokens are handed on in lists of at most SLICE. Other columns
are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sufloom.llm.common import cut, held, least_hashed, partitions_of, semi_join_ids, slices, small_batches
from sufloom.llm.tokenize import _LETTERS

LONGEST = 64
SLICE = 4096
ROWS = "row long, doc_id long, n_bytes long, first boolean, known long, tokens array<string>, times array<long>"
_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("first", pa.bool_()), ("known", pa.int64()), ("tokens", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])

# The pre-tokens of a lower-case word file, over the characters that _OTHER leaves; and those characters
# (outside ASCII, Latin letters and common marks, or counted differently by languages' expressions) for which the library
# itself splits.
_USUAL = rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+"
_OTHER = re.compile("[\x1c-\x1f\x80-\xa0\xb2\xb3\xb9\xbc-\xbe\u0250-\u200f\u2028-\u202f\u205f-\u20ab\u20ad-\U0010ffff]")
_PROBE = "It's 3 words,  well -- 'LL über\n\n\tŒuvre: x_12 I've…\n"


class Pretokens:
    """Pre-tokens of a text, and the number of pieces of one, by a file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        added = list(own.get_added_tokens_decoder().values())
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that are normalized, stripped or single words aren't supported")
        names = sorted((t.content for t in added), key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, names))) if names else None
        self._names = names
        self._normal, self._split, self._model = own.normalizer, own.pre_tokenizer.pre_tokenize_str, own.model.tokenize
        usual = re.compile(_USUAL)
        self._usual = usual if usual.findall(_PROBE.lower()) == list(self.by_library(_PROBE)) else None

    def by_library(self, text: str):
        normal = self._normal.normalize_str(text) if self._normal else text
        return (normal[a:b] for _, (a, b) in self._split(normal))

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """How many added tokens' strings the text holds, and its pre-tokens with their frequencies."""
        extra, parts = 0, [text]
        if self._added and any(n in text for n in self._names):
            parts = self._added.split(text)
            extra = len(parts) - 1
        out = None
        for part in parts:
            low = part.lower() if self._usual else ""
            if self._usual and (part.isascii() and not _OTHER.search(part) or not (_OTHER.search(part) or _OTHER.search(low))):
                found = self._usual.findall(low)
            else:
                found = self.by_library(part)
            if out is None:
                out = Counter(found)
            else:
                out.update(found)
        return extra, out

    def pieces(self, token: str) -> int:
        return sum(len(self._model(x)) for x, _ in self._split(token))


def pretokens(path: str) -> Pretokens:
    return held(("pretokens", path), lambda: Pretokens(path))


def frequency_rows(docs: DataFrame, path: str, known=None) -> DataFrame:
    """ROWS of documents (doc_id, n_bytes, text): lists of the pre-tokens that aren't in the broadcast dict `known` (of
    pieces), and in a document's first row the tokens of those that are."""

    def run(batches):
        from pyspark import TaskContext

        number, table, pieces = TaskContext.get().partitionId() << 33, pretokens(path), known.value if known else {}
        for batch in slices(batches, 500):
            out = []
            for doc_id, n_bytes, text in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("text")):
                total, counts = table.frequencies(text.as_py())
                rest = []
                for item in counts.items():
                    each = pieces.get(item[0])
                    if each is None:
                        rest.append(item)
                    else:
                        total += each * item[1]
                for at in range(0, max(1, len(rest)), SLICE):
                    own = rest[at : at + SLICE]
                    out.append((number, doc_id, n_bytes, at == 0, total if at == 0 else 0, [t for t, _ in own], [n for _, n in own]))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA) if out else pa.RecordBatch.from_pylist([], schema=_SCHEMA)

    return small_batches(docs).mapInArrow(run, ROWS)


def with_pieces(tokens: DataFrame, path: str) -> DataFrame:
    """(token, pieces) of distinct tokens."""

    def run(batches):
        table = pretokens(path)
        for batch in batches:
            own = batch.column("token")
            yield pa.RecordBatch.from_arrays([own, pa.array([table.pieces(t) for t in own.to_pylist()], pa.int64())], names=["token", "pieces"])

    return tokens.select("token").mapInArrow(run, "token string, pieces long")


def frequent_pieces(docs: DataFrame, path: str, frequent: int, sample: int) -> dict[str, int]:
    """Pieces of the pre-tokens that most documents of a sample hold: at most `frequent`, of at most LONGEST characters."""
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    ids = cut(least_hashed(keyed, "key", sample), "sampled-documents")
    some = semi_join_ids(keyed, ids, "key").dropDuplicates(["key"])
    tokens = frequency_rows(some.select("doc_id", "n_bytes", "text"), path).select(F.explode("tokens").alias("token"))
    top = tokens.where(F.length("token") <= LONGEST).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(frequent)
    return {r["token"]: r["pieces"] for r in with_pieces(top.repartition(8), path).collect()}  # at most `frequent` short rows


def count_tokens(docs: DataFrame, path: str, frequent: int = 100_000, sample: int = 8000) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of documents (doc_id, text) by the tokenizer file at path."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path, frequent, sample) if frequent else {})
    rows = cut(frequency_rows(docs, path, known), "pretoken-frequencies")
    each = rows.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("x")).select("row", F.col("x.tokens").alias("token"), F.col("x.times").alias("times"))
    distinct = cut(with_pieces(each.groupBy("token").agg(F.count("*").alias("n")).repartition(partitions_of(rows)), path), "pretoken-pieces")
    sums = each.join(distinct, "token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    firsts = rows.where("first").select("row", "doc_id", "n_bytes", "known")
    return firsts.join(sums, "row", "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_tokens"))
