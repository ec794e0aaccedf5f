"""Secrets in texts: base patterns, and character Markov models of random strings and ordinary identifiers.

DataFrame functions alone do the work. A pattern's spans follow from the lengths of its matches and of the gaps between
them. Tokens of at least MIN_TOKEN characters that hold a digit and a letter, and overlap no base span, are scored by the
log-likelihood ratio of two first-order Markov models: transitions between characters in random strings and in ordinary
identifiers, counted by Spark from labelled samples, with add-one smoothing. Tokens whose ratio is at least `least_ratio`,
and `least_mean` for each transition, are spans of the kind markov. The model is one array of numbers of fixed size, put into the plan as a constant.

labelled_samples derives such samples from a bounded number of documents (those with the least hashes): values of base
spans and digests of words, in several spellings, are random strings; words, pairs of words and words with numbers are
identifiers. Any DataFrame of (token, label) serves as well.

Defined results: a null text counts as empty, without spans. Spans are in code points, the end exclusive. Repeated rows
come back as often as they came. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sufloom.llm.common import least_hashed

KINDS = ("assign", "access", "hex", "markov")
# Patterns, the group whose length counts, and the least length, of the base kinds.
BASE = (
    (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (r"AKIA[A-Z0-9]+", 0, 20),
    (r"[0-9a-f]+", 0, 24),
)
# The same matches long enough; cheap to look for in a text first.
HINTS = (BASE[0][0], r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}")
MIN_TOKEN = 20
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
CODES = 128
SLICE = 256  # matches
PIECE = 1024  # characters


def let(value: Column, use) -> Column:
    """use(value), the value being computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def found(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Array of (start, kind, end, value) of the pattern's leftmost matches, one after another."""
    p = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    rows = F.filter(F.transform(parts, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), x["value"].alias("value"))), lambda x: x["hit"].isNotNull())
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    size = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"]))

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def slices_of(rows):
        last = F.greatest(F.floor((F.size(rows) - 1) / SLICE), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(rows, i * SLICE + 1, SLICE))

    def spans_of(slices):
        # Each slice of the matches with the place where it begins, so that no long list grows one by one.
        begins = F.aggregate(slices, F.array(F.lit(0)), lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + size(part))))
        return let(begins, lambda at: F.flatten(F.transform(slices, lambda part, i: F.aggregate(part, F.struct(F.element_at(at, i + 1).alias("at"), nothing.alias("out")), add, lambda acc: acc["out"]))))

    return let(rows, lambda r: let(slices_of(r), spans_of))


def base_spans(text: Column) -> Column:
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    each = [F.when(text.rlike(hint), found(text, p, g, n, k)).otherwise(none) for k, ((p, g, n), hint) in enumerate(zip(BASE, HINTS))]
    return F.array_sort(F.concat(*each))


def labelled_samples(docs: DataFrame, documents: int = 500) -> DataFrame:
    """token and label (1: random, 0: identifier) derived from the texts of so many documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = docs.select("doc_id", text.alias("text")).join(F.broadcast(least_hashed(docs, "doc_id", documents)), "doc_id", "left_semi")
    some = some.groupBy("doc_id").agg(F.min("text").alias("text"))  # of rows that share a doc_id one text, so that the sample keeps its bound
    values = some.select(F.explode(F.transform(base_spans(F.col("text")), lambda s: s["value"])).alias("token")).where(F.length("token") >= MIN_TOKEN)
    words = some.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"[A-Za-z]{4,}"), F.lit(0))).alias("w")).distinct()
    number = F.pmod(F.xxhash64("w"), F.lit(10000)).cast("string")
    digest = F.sha2(F.col("w"), 256)
    spelt = F.array(digest, F.upper(F.md5("w")), F.base64(F.unhex(digest)), F.translate(F.base64(F.unhex(F.sha1("w"))), "+/", "-_"))
    named = F.array(F.col("w"), F.lower("w"), F.upper("w"), F.concat("w", number), F.concat(F.lower("w"), F.lit("_"), F.reverse(F.lower("w"))), F.concat(F.lower("w"), F.initcap("w")), F.concat(F.lower("w"), F.lit("-"), number), F.concat(F.lit("/"), F.lower("w"), F.lit("/")))
    return values.select("token", F.lit(1).alias("label")).unionByName(words.select(F.explode(spelt).alias("token"), F.lit(1).alias("label"))).unionByName(words.select(F.explode(named).alias("token"), F.lit(0).alias("label")))


def train(samples: DataFrame) -> list[float]:
    """Log ratios of the two models' transition probabilities, at 128 * code of a character + code of the next."""
    at = F.explode(F.sequence(F.lit(1), F.length("token") - 1))
    pairs = samples.where((F.length("token") >= 2) & F.col("token").rlike(r"^[\x00-\x7F]+$")).select("label", "token", at.alias("i"))
    code = F.ascii(F.substring("token", F.col("i"), F.lit(1))) * CODES + F.ascii(F.substring("token", F.col("i") + 1, F.lit(1)))
    counts = pairs.select("label", code.alias("code")).groupBy("code").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    every = samples.sparkSession.range(CODES * CODES).select(F.col("id").cast("int").alias("code"))
    filled = every.join(counts, "code", "left").select("code", F.expr("code div 128").alias("first"), F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n0", F.lit(0)).alias("n0"))
    firsts = filled.groupBy("first").agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    symbols = 66.0  # letters, digits and four signs
    ratio = F.log((F.col("n1") + 1) / (F.col("t1") + symbols)) - F.log((F.col("n0") + 1) / (F.col("t0") + symbols))
    rows = filled.join(firsts, "first").select("code", ratio.alias("r")).collect()  # 128 * 128 numbers
    return [r["r"] for r in sorted(rows, key=lambda r: r["code"])]


def spans(text: Column, ratios: list[float], least_ratio: float = 12.0, least_mean: float = 1.25) -> tuple[Column, Column]:
    """Base spans and spans of all kinds as arrays of (start, kind, end, value), each in order of start and kind."""
    base = base_spans(text)
    table = F.from_json(F.lit(json.dumps([round(x, 4) for x in ratios])), "array<double>")

    def ratio(token):
        # The token is split once and folded over, so that time grows with its length.
        codes = F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), F.ascii)
        start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))
        step = lambda acc, c: F.struct(c.alias("before"), F.when(acc["before"] < 0, 0.0).otherwise(acc["sum"] + F.element_at(table, acc["before"] * CODES + c + 1)).alias("sum"))
        return F.aggregate(codes, start, step, lambda acc: acc["sum"])

    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    tokens = F.when(text.rlike(TOKEN), F.filter(found(text, TOKEN, 0, MIN_TOKEN, 3), lambda x: mixed(x["value"]))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))
    return base, F.filter(tokens, lambda x: ratio(x["value"]) >= F.greatest(F.lit(least_ratio), least_mean * (F.length(x["value"]) - 1)))


def scan(docs: DataFrame, samples: DataFrame | None = None, least_ratio: float = 12.0, least_mean: float = 1.25) -> DataFrame:
    """scanned (a struct of the columns of docs), base and found (arrays of start, kind, end, value); found holds the base spans too."""
    ratios = train(labelled_samples(docs) if samples is None else samples)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base, more = spans(text, ratios, least_ratio, least_mean)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("scanned"), base.alias("base"), more.alias("more"))
    apart = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    return rows.select("scanned", "base", F.array_sort(F.concat("base", apart)).alias("found"))


def digest_text(column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def masked(text: Column, found_: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by mask. The text is cut into pieces once, and what
    lies between the spans is taken from those, so that no span walks from the text's start."""
    none = F.array().cast("array<struct<low:int,high:int>>")

    def add(acc, s):
        gap = F.array(F.struct(acc["at"].alias("low"), s["start"].alias("high")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    def slices_of(rows):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / SLICE).cast("int")), lambda i: F.slice(rows, i * SLICE + 1, SLICE))

    def gaps_of(slices):
        # Where the spans before each slice end, the last of them for the rest of the text.
        ends = F.aggregate(slices, F.array(F.lit(0)), lambda acc, part: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.array_max(F.transform(part, lambda s: s["end"]))))))
        inner = lambda at: F.flatten(F.transform(slices, lambda part, i: F.aggregate(part, F.struct(F.element_at(at, i + 1).alias("at"), none.alias("out")), add, lambda acc: acc["out"])))
        return let(ends, lambda at: F.concat(inner(at), F.array(F.struct(F.element_at(at, -1).alias("low"), F.length(text).alias("high")))))

    def cut(pieces, gap):
        low, high = gap["low"], gap["high"]
        first, last = F.floor(low / PIECE).cast("int"), F.floor((high - 1) / PIECE).cast("int")
        one = lambda p: F.substring(F.element_at(pieces, p + 1), F.greatest(low - p * PIECE, F.lit(0)) + 1, F.least(high - p * PIECE, F.lit(PIECE)) - F.greatest(low - p * PIECE, F.lit(0)))
        return F.when(low < high, F.array_join(F.transform(F.sequence(first, last), one), "")).otherwise("")

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    done = let(pieces, lambda p: let(let(slices_of(found_), gaps_of), lambda gaps: F.array_join(F.transform(gaps, lambda g: cut(p, g)), mask)))
    return F.when(F.size(found_) > 0, done).otherwise(text)


def mask_secrets(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """docs with secrets masked in text, and n_chars counted anew where it is a column; a null text stays null."""
    text = F.col("scanned").getField("text")
    rows = scan(docs, samples).select("scanned", F.size("found").alias("hits"), F.when(text.isNotNull(), masked(text, F.col("found"))).alias("masked"))
    own = {c: F.col("scanned").getField(c) for c in docs.columns}
    own["text"] = F.col("masked")
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("hits") > 0, F.length(F.col("masked")).cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*(v.alias(c) for c, v in own.items()))
