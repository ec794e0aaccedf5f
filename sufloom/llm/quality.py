"""Quality of documents by regularised quadratic discriminant analysis over statistics of their texts.

One pass gives each document its transformed statistics. Counts, sums and outer products of the labelled rows, by class,
are summed by Spark over all of them; what reaches the driver is one mean and one covariance a class. A class covariance
is shrunk towards the pooled one and towards its diagonal, and its Cholesky factor is kept. The score is the logistic
function of the difference of the two log densities (Mahalanobis distances and log determinants) and of the log prior.

Defined results: a null text counts as empty; an empty text has its own statistics (zeros) and a score like any other.
Rows repeated in docs come back as often; a document labelled more than once counts with each label, a label that is
neither 0 nor 1 not at all. Without labelled rows of both classes every score is 1 (nothing is rejected). An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sufloom.llm.common import cut, slices, small_batches
from sufloom.llm.token_output import texts_of

FEATURES = (
    "log_words", "word_length", "long_words", "upper", "digits", "exclaim", "marks", "bars", "stops", "tails", "distinct", "repeats", "top_word", "line_words", "repeated_lines", "plain_words",
)
_MARKS = np.zeros(256)
_MARKS[[ord(c) for c in "#$%&*@^~_+=<>{}[]\\"]] = 1
_UPPER, _LOWER, _DIGIT = (np.zeros(256) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a text, each on a scale on which ordinary texts spread evenly."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    bytes_ = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = int(bytes_.sum())
    upper, lower, digit, marks = (float((bytes_ * m).sum()) for m in (_UPPER, _LOWER, _DIGIT, _MARKS))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    letters = size - int(bytes_[32]) - int(bytes_[10])
    repeats = sum(map(eq, words, words[1:]))
    log = lambda part, whole: math.log((part + 0.5) / (whole + 50.0) + 1e-3)
    return [
        math.log(n + 1),
        math.log((letters + 5) / (n + 1)),
        log(sum(len(w) > 14 for w in words), n),
        log(upper, upper + lower),
        log(digit, size),
        log(float(bytes_[33]), n),
        log(marks, n),
        log(float(bytes_[124]), n),
        log(float(bytes_[46]), n),
        log(sum(not w[-1].isalnum() for w in words), n),
        math.log((len(counts) + 5) / (n**0.8 + 5)),
        log(repeats, n),
        log(max(counts.values()) - 1, n),
        math.log((n + 1) / (len(lines) + 1)),
        log(len(lines) - len(set(lines)), len(lines)),
        log(sum(w.islower() and w.isalpha() for w in words), n),
    ]


def features(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])

    return small_batches(texts_of(docs)).mapInArrow(run, "doc_id long, x array<double>")


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of (label, x) rows, by label: number, sum, and sum of outer products, added up by Spark."""
    d = len(FEATURES)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for c in np.unique(y).tolist():
                own = np.concatenate([np.ones((int((y == c).sum()), 1)), x[y == c]], axis=1)
                sums[c] = sums.get(c, 0) + np.einsum("ni,nj->ij", own, own)
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], names=["label", "s"])

    parts = rows.mapInArrow(run, "label int, s array<double>").select("label", F.posexplode("s").alias("i", "v"))
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("label", "i").agg(F.sum("v").alias("v")).collect():  # two classes, (d + 1)^2 numbers each
        out.setdefault(r["label"], np.zeros((d + 1) ** 2))[r["i"]] = r["v"]
    return {c: (s[0], s.reshape(d + 1, d + 1)[0, 1:], s.reshape(d + 1, d + 1)[1:, 1:]) for c, s in out.items()}


class Discriminant:
    """Class means, Cholesky factors and log determinants; made once on the driver, small."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float, to_diagonal: float, prior: float | None):
        self.ready = all(c in sums and sums[c][0] > 1 for c in (0, 1))
        if not self.ready:
            return
        total = sum(n for n, _, _ in sums.values())
        means = {c: s / n for c, (n, s, _) in sums.items()}
        covs = {c: q / n - np.einsum("i,j->ij", means[c], means[c]) for c, (n, _, q) in sums.items()}
        pooled = sum(sums[c][0] / total * covs[c] for c in covs)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        grid = np.einsum("i,j->ij", self.scale, self.scale)
        self.parts = {}
        for c in (0, 1):
            cov = ((1 - to_pooled) * covs[c] + to_pooled * pooled) / grid
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov) + 0.1)
            factor = np.linalg.cholesky(cov)
            self.parts[c] = (means[c] / self.scale, factor, float(np.log(np.diag(factor)).sum()))
        share = sums[1][0] / total if prior is None else prior
        self.prior = math.log(share / (1 - share))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.ones(len(x))
        density = {}
        for c, (mean, factor, logdet) in self.parts.items():
            z = (x / self.scale - mean).T.copy()
            for i in range(len(factor)):  # forward substitution by the cached factor
                z[i] = (z[i] - (factor[i, :i, None] * z[:i]).sum(axis=0)) / factor[i, i]
            density[c] = -0.5 * (z**2).sum(axis=0) - logdet
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -700, 700)))


def train(own: DataFrame, labels: DataFrame, held_out: Column, to_pooled: float = 0.1, to_diagonal: float = 0.05, prior: float | None = None) -> Discriminant:
    """The model of features `own` (doc_id, x) and labels (doc_id, label 0 or 1); held_out: of doc_id."""
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    return Discriminant(moments(own.where(~held_out).join(labelled, "doc_id").select("label", "x")), to_pooled, to_diagonal, prior)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. labels: doc_id and label (0 or 1); held_out: of doc_id."""
    own = cut(features(docs), "quality-features")
    model = train(own, labels, held_out, **options)
    d = len(FEATURES)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = own.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, held_out: Column, **options) -> DataFrame:
    """The rows of docs with a score of at least 0.5, in their own columns; the texts are not shuffled."""
    model = train(cut(features(docs), "quality-features"), labels, held_out, **options)

    def run(batches):
        for batch in slices(batches):
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= 0.5))

    return small_batches(docs).mapInArrow(run, docs.schema)
