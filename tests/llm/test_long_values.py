"""One token, one URL and one text of a million characters: whole results in a time that grows with the length."""

import random
import time

from pyspark.sql import functions as F

from sufloom.llm import secrets, url_filter

_RNG = random.Random(9)
SAMPLES = [("".join(_RNG.choices("abcXYZ0189_-/qKLmTvWn2457", k=40)), 1) for _ in range(80)] + [(w, 0) for w in ("user_name_field", "getElementById", "article-2024", "ordinary_identifier_name", "identifier_12345") * 40]


def in_time(rows, seconds=20):
    began = time.time()
    out = rows.collect()
    assert time.time() - began < seconds
    return out


def log_ratio(token, ratios):
    return sum(ratios[ord(a) * 128 + ord(b)] for a, b in zip(token, token[1:]))


def test_markov_spans_are_those_of_a_plain_sum(spark):
    import re

    rng = random.Random(4)
    words = ["".join(rng.choices("abcXYZ0189_-/", k=rng.randint(18, 40))) for _ in range(60)] + ["ordinary_identifier_name_12345", "a8Kq2Zx9Lm4Tv7Wb1Qn5R", "KEY=" + "q7" * 12]
    samples = spark.createDataFrame(SAMPLES, "token string, label int")
    ratios = [round(x, 4) for x in secrets.train(samples)]
    texts = [" ".join(words[i : i + 4]) for i in range(0, len(words), 4)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan(docs, samples).select("scanned.doc_id", "base", "found").collect()}
    some = 0
    for i, text in enumerate(texts):
        base = [(s["start"], s["end"]) for s in got[i]["base"]]
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
            v = m.group()
            mixed = re.search("[0-9]", v) and re.search("[A-Za-z]", v)
            if mixed and log_ratio(v, ratios) >= max(12.0, 1.25 * (len(v) - 1)) and not any(a < m.end() and b > m.start() for a, b in base):
                want.append((m.start(), m.end()))
        assert [(s["start"], s["end"]) for s in got[i]["found"] if s["kind"] == 3] == want
        some += len(want)
    assert 0 < some < len(words)


def test_masks_of_overlapping_spans_across_pieces(spark):
    text = "é" * 1000 + "password=abcdef0123456789abcdef0123456789 x" + "ü" * 2000 + "AKIA" + "A" * 16 + "AKIAZ" + "b" * 30
    docs = spark.createDataFrame([(0, text), (1, "clean"), (2, None), (3, "token=abcdefg")], "doc_id long, text string")
    samples = spark.createDataFrame(SAMPLES, "token string, label int")
    for r in secrets.scan(docs, samples).select("scanned.text", "found", secrets.masked(F.coalesce("scanned.text", F.lit("")), F.col("found")).alias("m")).collect():
        out, at = "", 0
        for s in r["found"]:
            if s["start"] >= at:
                out += (r["text"] or "")[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        assert r["m"] == out + (r["text"] or "")[at:]


def test_a_token_and_a_text_of_a_million_characters(spark):
    samples = spark.createDataFrame(SAMPLES, "token string, label int")
    rows = spark.range(2).selectExpr("id AS doc_id", "CASE WHEN id = 0 THEN repeat('a8Kq2Zx9L', 111112) ELSE repeat(concat(repeat('plain words ', 7), 'token=abcdef9876 '), 10000) END AS text")
    got = {r["doc_id"]: r for r in in_time(secrets.mask_secrets(rows, samples).select("doc_id", F.length("text").alias("n"), F.substring("text", 1, 100).alias("head")))}
    assert got[0]["n"] in (8, 1000008) and got[1]["n"] == 10000 * (84 + 9) and got[1]["head"].startswith("plain words " * 7 + "[SECRET]")


def test_a_url_of_a_million_characters(spark):
    pages = spark.range(1).selectExpr("id AS page_id", "concat('http://example.com/', repeat('abcdefgh/', 111111)) AS url")
    r = in_time(url_filter.judge(pages, [], [0.0] * 4097))[0]
    assert (len(r["path"]), r["verdict"]) == (1_000_000, "allow")
