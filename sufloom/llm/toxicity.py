"""Toxicity by a support vector machine with a gap-weighted subsequence string kernel and Nyström landmarks.

Words are compared by the subsequences of three characters within a window of `SPAN`, a wider spread weighing less by
`DECAY` a character (word ends count as characters). So a word matches an insult through inserted characters, gaps and
other endings; marks between letters are left out, and letters set apart by spaces are read as one word. The kernel of two
words is the normalised inner product to the power `POWER`; that of two sentences is its sum over their distinct words.
The Nystroem map to `landmarks` words makes the machine linear, so each word has one value, computed once for each
distinct word, and a sentence's value is their sum and the constant. A document is judged by its two greatest sentences.

Training: of the labelled rows, `per_class` documents of either label with the least hashes (a stated bound; the counts
come from Spark jobs over them); landmarks are words that at least `least_share` of the toxic documents hold, and
`least_lift` times as large a share of them as of the clean ones, and the ordinary words most like those; the machine is
fitted on the labelled sentences, of each document the `PER_DOCUMENT` most like a landmark; a logistic curve over the
documents' two greatest sentence values gives the score.

Defined results: a null text counts as empty; a text without words is judged as an empty sentence, by the constant. Rows
repeated in docs come back as often; a document labelled more than once counts with each label, labels other than 0 and 1
not at all; of rows that share a labelled doc_id the least text is learned from. Without labelled rows of both classes
every score is 0 (nothing is rejected). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sufloom.llm.common import cut, discard, held, least_hashed, slices, small_batches
from sufloom.llm.token_output import texts_of

SPAN, DECAY, POWER = 6, 0.8, 4
PER_DOCUMENT = (3, 1)  # sentences that a clean and a toxic document train the machine with
LEAST_EIGENVALUE = 1e-3
TABLE = 1 << 18
_OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]
_WEIGHTS = np.array([DECAY ** (b - 2) for _, b in _OFFSETS])
_SPACED = re.compile(r"(?<!\S)\w(?: \w){3,}(?!\S)")
ENDS = ".!?"
_BETWEEN = str.maketrans("", "", "*-_.~^+=")
_STRIP = " \t\r\n.,;:!?\"'()[]{}<>|#$%&*"


def plain(token: str) -> str:
    """A token as the kernel reads it, without marks between its letters."""
    return token.strip(_STRIP).translate(_BETWEEN).lower()


def tokens_of(text: str | None) -> list[str]:
    tokens = (text or "").split()
    return tokens + [m.group().replace(" ", "") for m in _SPACED.finditer(text)] if tokens else tokens


def occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' subsequences: owner (word number), code, weight; and the norm of each word."""
    marked = ["\x02" + w + "\x03" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in marked])
    own, code, weight = [], [], []
    for (a, b), w in zip(_OFFSETS, _WEIGHTS):
        if len(chars) <= b:
            continue
        inside = np.flatnonzero(owner[:-b] == owner[b:])
        h = (chars[inside] * np.uint64(0x9E3779B1) + chars[inside + a] * np.uint64(0x85EBCA77) + chars[inside + b] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
        h ^= h >> np.uint64(15)
        h = h * np.uint64(0x2C1B3C6D) & np.uint64(0xFFFFFFFF)
        own.append(owner[inside])
        code.append((h >> np.uint64(14)).astype(np.int64))
        weight.append(np.full(len(inside), w))
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.ones(len(words))
    # A subsequence that a word has more than once counts with the sum of its weights.
    key, at = np.unique(np.concatenate(own) * TABLE + np.concatenate(code), return_inverse=True)
    weight = np.bincount(at, weights=np.concatenate(weight))
    own, code = key // TABLE, key % TABLE
    return own, code, weight, np.sqrt(np.maximum(np.bincount(own, weights=weight**2, minlength=len(words)), 1e-12))


class Landmarks:
    """Kernel values of words against the landmarks."""

    def __init__(self, words: list[str]):
        self.words = words
        own, code, weight, norm = occurrences(words)
        known, at = np.unique(code, return_inverse=True)
        self.row = np.zeros(TABLE, np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(words)), np.float32)
        np.add.at(self.table, (at + 1, own), weight / norm[own])

    def kernel(self, words: list[str], block: int = 4_000) -> np.ndarray:
        """Kernel values, a row a word."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        for s in range(0, len(words), block):
            part = words[s : s + block]
            own, code, weight, norm = occurrences(part)
            row = self.row[code]
            some = np.flatnonzero(row)
            order = some[np.argsort(own[some], kind="stable")]
            for at in range(0, len(order), 40_000):  # a few words whose occurrences straddle a cut add up
                o = order[at : at + 40_000]
                rows = self.table[row[o]] * (weight[o] / norm[own[o]]).astype(np.float32)[:, None]
                starts = np.flatnonzero(np.diff(own[o], prepend=-1))
                out[s + own[o][starts]] += np.add.reduceat(rows, starts, axis=0)
        return np.minimum(out, 1.0) ** POWER


def landmark_words(insults: list[str], ordinary: list[str], count: int) -> list[str]:
    """The insults, and of the ordinary words those most like one of them, which the machine must tell apart."""
    if not insults:
        return []
    alike = Landmarks(insults).kernel(ordinary).max(axis=1) if ordinary else np.zeros(0)
    order = np.argsort(-alike, kind="stable")[: count - len(insults)]
    return insults + [ordinary[i] for i in order if alike[i] >= 0.1]


def sentences(tokens: list[str]) -> list[list[str]]:
    out, now = [], []
    for t in tokens:
        now.append(t)
        if t[-1] in ENDS:
            out.append(now)
            now = []
    return [*out, now] if now else out


def fit_machine(x: np.ndarray, y: np.ndarray, ridge: float = 3e-4, rounds: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss, classes weighing alike, by Newton steps on the rows inside the margin.
    The last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(float)
    s = np.where(y == 1, 1.0, -1.0)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y != 1).sum()))
    w, inside = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(rounds):
        active = weight * inside
        w = np.linalg.solve(np.einsum("i,ij,ik->jk", active, x, x, optimize=True) + ridge * np.eye(len(w)), np.einsum("i,ij->j", active * s, x))
        new = s * np.einsum("ij,j->i", x, w) < 1
        if (new == inside).all():
            break
        inside = new
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", x, w), -30, 30)))
        grad = np.einsum("i,ij->j", p - y, x) + ridge * w
        hess = np.einsum("i,ij,ik->jk", p * (1 - p), x, x) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


class WordValues:
    """The machine's value of each token. A token met again, and a plain word met again, keep theirs, up to `most` entries
    of each."""

    def __init__(self, landmarks: Landmarks, values: np.ndarray, most: int = 150_000):
        self.landmarks, self.values, self.most = landmarks, values, most
        self.tokens: dict[str, float] = {}
        self.plains: dict[str, float] = {}
        self.met = bytearray(1 << 20)

    def keep(self, known: dict[str, float], word: str, value: float) -> None:
        at = hash(word) & 0xFFFFF
        if self.met[at] and len(known) < self.most and len(word) <= 40:
            known[word] = value
        self.met[at] = 1

    def of(self, tokens: list[str]) -> np.ndarray:
        """Values of distinct tokens."""
        values = list(map(self.tokens.get, tokens))
        late = [i for i, v in enumerate(values) if v is None]
        words = [plain(tokens[i]) for i in late]
        fresh = list(dict.fromkeys(w for w in words if w not in self.plains))
        new = dict(zip(fresh, np.einsum("ij,j->i", self.landmarks.kernel(fresh), self.values).tolist())) if fresh else {}
        for i, w in zip(late, words):
            v = self.plains.get(w)
            values[i] = new[w] if v is None else v
            self.keep(self.tokens, tokens[i], values[i])
        for w, v in new.items():
            self.keep(self.plains, w, v)
        return np.array(values, float)

    def greatest(self, texts: list[str | None], constant: float) -> np.ndarray:
        """The machine's two greatest values of a sentence of each text; those of an empty sentence where there is none."""
        number: dict[str, int] = {}
        each = [tokens_of(t) for t in texts]
        at = np.array([number.setdefault(t, len(number)) for doc in each for t in doc], np.int64)
        out = np.full((len(texts), 2), constant)
        if not len(at):
            return out
        distinct = list(number)
        lens = np.array([len(doc) for doc in each])
        some = np.flatnonzero(lens)
        first = (np.cumsum(lens) - lens)[some]  # of each text with words
        begins = np.zeros(len(at), bool)
        begins[1:] = np.array([t[-1] in ENDS for t in distinct])[at[:-1]]
        begins[first] = True
        starts = np.flatnonzero(begins)
        # A sentence counts a token once.
        pairs = np.unique((np.cumsum(begins) - 1) * len(distinct) + at)
        sums = np.bincount(pairs // len(distinct), weights=self.of(distinct)[pairs % len(distinct)], minlength=len(starts)) + constant
        own = np.repeat(some, np.diff(np.searchsorted(starts, first), append=len(starts)))
        order = np.lexsort((sums, own))
        ends = np.flatnonzero(np.diff(own, append=-1))  # each text's last place in that order
        out[some, 0] = sums[order[ends]]
        more = np.diff(ends, prepend=-1) > 1
        out[some[more], 1] = sums[order[ends[more] - 1]]
        return out


class Scorer:
    """Landmarks, word values, the machine's constant and the logistic curve: all that a task needs to score texts."""

    def __init__(self, words: list[str], values: np.ndarray, constant: float, curve: np.ndarray | None = None):
        self.words, self.values, self.constant, self.curve = words, values, constant, curve

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        own = held((tuple(self.words), self.values.tobytes()), lambda: WordValues(Landmarks(self.words), self.values))
        return np.concatenate([np.zeros((0, 2)), *(own.greatest(texts[at : at + 250], self.constant) for at in range(0, len(texts), 250))])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", self.evidence(texts), self.curve[:-1]) + self.curve[-1], -500, 500)))


def train(docs: DataFrame, labels: DataFrame, held_out: Column, per_class: int = 2000, landmarks: int = 128, least_lift: float = 4.0, least_share: float = 0.01) -> Scorer | None:
    """The scorer, or None where the labelled rows teach nothing. labels: doc_id and label (0 or 1); held_out: of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out)
    chosen = [least_hashed(known.where(F.col("label") == c), "doc_id", per_class).withColumn("label", F.lit(c)) for c in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class ids
    # Of rows that share a doc_id, one text, so that the sample keeps its bound.
    sample = cut(small_batches(texts_of(docs).join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))), "toxicity-sample")
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (counts.get(0) and counts.get(1)):
        return None

    def words_of(batches):
        for batch in slices(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = sorted({p for t in tokens_of(text) if 3 <= len(p := plain(t)) <= 40})
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([label] * len(words), pa.int32())], names=["word", "label"])

    met = sample.mapInArrow(words_of, "word string, label int").groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    p, q = (F.col("toxic") + 0.5) / (counts[1] + 1), (F.col("clean") + 0.5) / (counts[0] + 1)
    met = cut(met.where("toxic + clean >= 3").withColumn("lift", p / q), "toxicity-words")
    often = F.col("toxic") >= least_share * counts[1]
    insults = [r["word"] for r in met.where(often & (F.col("lift") >= least_lift)).orderBy(F.desc(F.col("toxic") * F.log("lift")), "word").limit(landmarks * 3 // 4).collect()]
    ordinary = [r["word"] for r in met.where(F.col("lift") < least_lift / 2).orderBy(F.desc("clean"), "word").limit(20_000).collect()]
    words = landmark_words(insults, ordinary, landmarks)
    if not words:
        return None
    marks = Landmarks(words)

    def best_sentences(batches):
        for batch in slices(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                parts = sentences(tokens_of(text))
                if not parts:
                    continue
                flat = sorted({t for s in parts for t in s})
                at = {t: i for i, t in enumerate(flat)}
                k = marks.kernel([plain(t) for t in flat])
                sums = np.array([k[sorted({at[t] for t in s})].sum(axis=0) for s in parts])
                best = sums[np.argsort(-sums.max(axis=1), kind="stable")[: PER_DOCUMENT[label]]]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(best), pa.int32()), pa.array(best.tolist(), pa.list_(pa.float32()))], names=["label", "k"])

    rows = sample.mapInArrow(best_sentences, "label int, k array<float>").collect()  # at most four times per_class rows
    y, k = np.array([r["label"] for r in rows]), np.array([r["k"] for r in rows], float)
    value, vector = np.linalg.eigh(marks.kernel(words).astype(float))
    whiten = np.einsum("ij,j,kj->ik", vector, 1 / np.sqrt(np.maximum(value, LEAST_EIGENVALUE)), vector)
    weights = fit_machine(np.einsum("ij,jk->ik", k, whiten), y)
    values = np.einsum("ij,j->i", whiten, weights[:-1])
    unfinished = Scorer(words, values, float(weights[-1]))

    def labelled(batches):
        for batch in slices(batches):
            x = unfinished.evidence(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "x"])

    rows = sample.mapInArrow(labelled, "label int, x array<double>").collect()  # at most twice per_class rows of three numbers
    curve = fit_logistic(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))
    discard(sample, met)
    return Scorer(words, values, float(weights[-1]), curve)


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. labels: doc_id and label (0 or 1); held_out: of doc_id."""
    scorer = train(docs, labels, held_out, **options)

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            scores = scorer.score(texts) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = small_batches(texts_of(docs)).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, held_out: Column, **options) -> DataFrame:
    """The rows of docs with a score under 0.5, in their own columns; the texts are not shuffled."""
    scorer = train(docs, labels, held_out, **options)
    if scorer is None:
        return docs

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(scorer.score(batch.column("text").to_pylist()) < 0.5))

    return small_batches(docs).mapInArrow(run, docs.schema)
