import random
import re

import duckdb
import numpy as np
from sufloom.llm import near_dedup as nd
from sufloom.llm import op1
from sufloom.llm.common import components
from sufloom.llm.wordhash import pieces_at_spaces, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, width=2):
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    own = list(range(len(texts)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                own[max(a, b)] = min(a, b)
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def cases():
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(60)]
    texts = [None, "", " \t\n", "one", "One", "ONE two", "one  two", "É x", "é x"]
    for _ in range(120):  # near copies of one text, some above and some below the threshold
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 5
    texts.append(" ".join(f"w{rng.randrange(10**6)}" for _ in range(30_000)))
    texts.append(texts[-1] + " tail")
    return texts


def test_equals_brute_force(docs_of):
    texts = cases()
    got = nd.near_duplicates(docs_of(texts, extra=True), block_rows=16).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_five_word_shingles(docs_of):
    texts = cases()
    got = nd.near_duplicates(docs_of(texts), width=5).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(texts, 5)


def test_one_of_each_group_stays_in_its_own_columns(spark, docs_of):
    docs = docs_of(["a b c", "a b c", "d e f", None], extra=True)
    kept = nd.keep_one_per_component(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_empty_table_and_null_ids(spark, docs_of):
    assert nd.near_duplicates(docs_of([]).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (None, "x y")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in nd.near_duplicates(rows).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = sorted(map(tuple, con.execute(op1.ORACLE_SQL).fetchall()))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in op1.query(spark, sf).collect())
    assert got == want


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for j in (0.6, 0.8, 0.9):
        n = 4000
        shared = rng.integers(0, 2**63, int(n * j), dtype=np.uint64)
        rest = rng.integers(0, 2**63, n - len(shared), dtype=np.uint64)
        a, b = np.concatenate([shared, rest[::2]]), np.concatenate([shared, rest[1::2]])
        sketches = nd.odd_sketch(nd.minhash([a, b], nd.FINE_SAMPLES), nd.FINE_WORDS)
        z = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
        bits = nd.FINE_WORDS * 64
        apart = -bits / 2 * np.log(1 - 2 * z / bits)
        assert abs(1 - apart / (2 * nd.FINE_SAMPLES) - j) < 0.05
        assert (z <= nd.sketch_cut(0.8, nd.FINE_SAMPLES, nd.FINE_WORDS)) == (j >= 0.8)


def test_long_texts_hash_alike_in_pieces():
    text = " ".join(str(i * 7919 % 1000) for i in range(5000))
    assert "".join(pieces_at_spaces(text, 100)) == text
    whole, parts = next(shingle_sets([text])), next(shingle_sets([text], block=500))
    assert (whole == parts).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 103: 100}
