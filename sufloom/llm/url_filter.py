"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest.

DataFrame functions alone do the work. A URL's features are the distinct md5 hashes, into `dim` buckets, of the n-grams of
"^host$" and of "^path$", those of the host and of the path apart. The model is trained on a small labelled table (`url`,
`label`: 1 is block) by `epochs` gradient steps over all its rows, in one expression: each weight shrinks by `decay` and
moves by the gaps of the rows that hold its bucket, divided by their number plus `smooth`, so that rare n-grams count
less. Weights are a constant of fixed size in the scoring plan.

Defined results: a null url, or one without "://", has an empty host and path, no rule and the verdict of the model for
empty features (its constant). Repeated rows come back as often as they came. A training table without rows gives the
verdict allow. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Buckets of n-grams.
DIM = 4096

# Words of labelled hosts and paths: fixed values. labelled_urls() makes the labelled table from them by rule.
BLOCKED_WORDS = (
    "casino poker roulette jackpot slots betting bookmaker gambling lottery bingo viagra pharmacy pills steroids porn xxx adult "
    "escorts webcams nudes erotic sexchat payday moneylender adserver adclick banners popups tracker tracking spam spammers "
    "malware phishing spyware warez keygen cracked replica counterfeit"
).split()
ORDINARY_WORDS = (
    "news weather library museum history travel recipes cooking garden school university science physics biology chemistry "
    "mathematics language grammar dictionary theatre concert orchestra painting gallery literature poetry novel review journal "
    "archive research hospital medicine clinic nursing council parliament election justice railway airport harbour bridge "
    "village mountain forest river island football cycling running swimming chess carpentry pottery knitting computing "
    "software database compiler network documentation tutorial astronomy geology climate farming beekeeping market bakery "
    "radio television cinema photography architecture furniture insurance banking pension translation"
).split()
COMMON_WORDS = "my the new best top online world city west north group team club land daily direct point zone central first pro net".split()
SYLLABLES = "ba ber con da dor el fen gar hal in jo ka lan mer nor on per qui ran sel ta the tion ul ver wen xi yor zan st".split()
SECTIONS = "en de fr es it pages articles item view go".split()


def labelled_urls(n: int = 900) -> list[tuple[str, int]]:
    """n URLs with labels (1 is block), two in three ordinary. A host's name is a word of its class, alone or with a common
    word or a second word of its class; a third of the ordinary ones are names made of syllables. Subdomains, domains
    (reserved for examples), sections and numbers are drawn alike for both classes; some paths hold a word of the class."""

    def pick(i: int, what: str, options: list[str]) -> str:
        return options[zlib.crc32(f"{i} {what}".encode()) % len(options)]

    def one(i: int) -> tuple[str, int]:
        block = i % 3 == 0
        words = BLOCKED_WORDS if block else ORDINARY_WORDS
        word, second, common = pick(i, "word", words), pick(i, "second", words), pick(i, "common", COMMON_WORDS)
        name = pick(i, "name", [word, f"{word}-{common}", f"{common}-{word}", f"{word}{common}", f"{common}{word}", f"{word}-{second}", f"{word}{second}"])
        if i % 3 == 2 and i % 2:
            name = "".join(pick(i, f"syllable {k}", SYLLABLES) for k in range(2 + i % 4))
        host = pick(i, "sub", ["", "", "www.", "m.", "blog."]) + name + ".example." + pick(i, "domain", ["com", "org", "net"])
        number = str(zlib.crc32(f"{i} number".encode()) % 10000)
        section = pick(i, "section", SECTIONS)
        path = pick(i, "path", [f"/{section}/{number}", f"/{section}/{number}/", f"/{section}/{number}.html", f"/{second}/{number}", f"/{section}/{word}", "/"])
        return pick(i, "scheme", ["http://", "https://"]) + host + path, int(block)

    return [one(i) for i in range(n)]

# (host and subdomains, first part of the path, verdict)
Rule = tuple[str, str, str]


def parsed(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; of rules of one length the first listed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    chain = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        one = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, one) if chain is None else chain.when(fits, one)
    return out if chain is None else chain


def grams(text: Column, kind: str, widths: tuple[int, ...], dim: int) -> Column:
    """Buckets of the n-grams; the text is split into characters once, so that time grows with its length."""
    marked = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit("(?s)."), F.lit(0))

    def hashed(chars: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1)))
        return F.transform(at, lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(kind), F.array_join(F.slice(chars, i, n), ""))), 1, 4), 16, 10).cast("int") % dim)

    return F.element_at(F.transform(F.array(marked), lambda chars: F.concat(*(hashed(chars, n) for n in widths))), 1)


def features(host: Column, path: Column, widths: tuple[int, ...] = (3, 4), dim: int = DIM) -> Column:
    """Distinct buckets of the n-grams; none for an empty host and path."""
    none = F.array().cast("array<int>")
    return F.when(F.length(host) + F.length(path) > 0, F.array_distinct(F.concat(grams(host, "h", widths, dim), grams(path, "p", widths, dim)))).otherwise(none)


def train(labelled: DataFrame, dim: int = DIM, epochs: int = 60, rate: float = 8.0, decay: float = 1e-3, smooth: float = 4.0) -> list[float]:
    """Weights of the buckets and, last, the constant. labelled must be small: its rows meet in one expression. rate is divided
    by the mean number of features of a row."""
    host, path = parsed(F.col("url"))
    x = F.concat(features(host, path, dim=dim), F.array(F.lit(dim)))
    rows = labelled.select(x.alias("x"), F.col("label").cast("double").alias("y")).where("y is not null")
    rows = rows.select(F.struct("x", "y").alias("r"))
    numbered = rows.agg(F.array_sort(F.collect_list("r")).alias("rows")).select(F.posexplode("rows").alias("row", "r"))
    held = numbered.select("row", F.explode("r.x").alias("bucket"))
    held = labelled.sparkSession.range(dim + 1).join(held, F.col("id") == F.col("bucket"), "left").groupBy("id").agg(F.array_sort(F.collect_list("row")).alias("held"))
    both = rows.unionByName(held.select(F.struct("id", "held").alias("b")), allowMissingColumns=True)
    size = F.when(F.col("r").isNotNull(), F.size("r.x"))
    one = both.agg(F.array_sort(F.collect_list("r")).alias("rows"), F.array_sort(F.collect_list("b")).alias("buckets"), F.avg(size).alias("mean"))

    def gap(w, r):
        return r["y"] - 1 / (1 + F.exp(-F.aggregate(r["x"], F.lit(0.0), lambda s, i: s + F.element_at(w, i + 1))))

    def moved(w, gaps):
        def weight(b, j):
            total = F.aggregate(b["held"], F.lit(0.0), lambda s, row: s + F.element_at(gaps, row + 1))
            return F.element_at(w, j + 1) * (1 - decay) + rate / F.col("mean") * total / (F.size(b["held"]) + smooth)

        return F.transform("buckets", weight)

    def step(w, _):
        return F.element_at(F.transform(F.array(F.transform("rows", lambda r: gap(w, r))), lambda gaps: moved(w, gaps)), 1)

    zero = F.array_repeat(F.lit(0.0), dim + 1)
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), zero, step)
    return list(one.select(F.when(F.size("rows") > 0, fitted).otherwise(zero).alias("w")).first()["w"])


def judge(pages: DataFrame, rules: list[Rule], weights: list[float], dim: int = DIM) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability of block) of each row of pages (page_id, url)."""
    host, path = parsed(F.col("url").cast("string"))
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    z = F.aggregate(features(F.col("host"), F.col("path"), dim=dim), F.element_at(table, dim + 1), lambda s, i: s + F.element_at(table, i + 1))
    rows = rows.withColumns({"hit": rule, "score": 1 / (1 + F.exp(-z))})
    verdict = F.coalesce("hit.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")


def sample_urls(spark: SparkSession) -> DataFrame:
    rows = F.from_json(F.lit(json.dumps([{"url": u, "label": y} for u, y in labelled_urls()])), "array<struct<url:string,label:int>>")
    return spark.range(1).select(F.explode(rows).alias("x")).select("x.url", "x.label")
