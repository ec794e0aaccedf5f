"""Token counts, conversation repair and centroid clustering against the library and brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from sufloom.llm import op11, op12, op13
from sufloom.llm.centroid_clustering import Tournament, cluster_vectors
from sufloom.llm.conversation_repair import Repair, damaged, fault, repair_edits, repair_summaries
from sufloom.llm.token_counts import count_tokens

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path(op11.TOKENIZER)

# --- Token counts ----------------------------------------------------------------------------------------------------

TEXTS = [
    "a<|endoftext|>B<|startoftext|><|endoftext|>", "İstanbul ΑΣ ΣΑΣ", "éclair naïve ﬁ ½ x² 😀🏽 你好", "", "  ", "'s 'S 'll'll ''s !'s don't x", "K Å İ \x1c a\x85b\xa0c",
    "a" * 5000, "ȺȾẞ", "؀ก 12３ ٣", "word " * 3000, " ".join(f"w{i}x" for i in range(9000)), None,
]


def library(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)
    return [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("frequent", [0, 5, 100_000])
def test_counts_are_the_librarys_whichever_join_a_pretoken_takes(spark, frequent):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x"), (0, TEXTS[0], "x"), (0, TEXTS[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(docs, WORDS, frequent, 10).collect())
    want = library([t for _, t, _ in rows])
    assert got == sorted((-1 if i is None else i, len((t or "").encode()), n) for (i, t, _), n in zip(rows, want))


def test_op11_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], library([r.text for r in docs])))
    got = op11.query(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(docs)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_counts_of_an_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []


# --- Conversation repair ---------------------------------------------------------------------------------------------

LEGAL = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """All edits of a few rows (role, text, must go, truncated), with at most two insertions at each place: least cost, audit and lines."""
    best = []

    def insertions():
        return ((), ("u",), ("a",), ("u", "a"), ("a", "u"))

    def go(i, cost, audit, initials, lines):
        if best and cost > best[0][0]:
            return
        for added in insertions():
            c, a, s, t = cost + 3 * len(added), audit + "I" * len(added), initials + "".join(added), lines + tuple(f"{'user' if x == 'u' else 'assistant'}:" for x in added)
            if i == len(rows):
                if LEGAL.fullmatch(s):
                    best[:] = [min(best + [(c, a, t)])]
                continue
            role, text, must_go, cut = rows[i]
            go(i + 1, c + 4, a + "D", s, t)
            if not must_go:
                stays = c + 3 * cut
                go(i + 1, stays, a + "K", s + (role[:1] or "?"), (*t, f"{role}:{text}"))
                for other in ("user", "assistant"):
                    go(i + 1, stays + 3, a + "R", s + other[0], (*t, f"{other}:{text}"))

    go(0, 0, "", "", ())
    return best[0]


def test_least_edits_are_those_of_an_exhaustive_search(spark):
    draw = random.Random(5)
    rows, want = [], {}
    for conv in range(60):
        turns = [(draw.choice(["user", "assistant", "system", "tool", ""]) if conv % 2 else draw.choice(["user", "assistant"]), draw.choice(["Yes.", "No!", "cut", "", " \n", "Why?"])) for _ in range(draw.randint(0, 4))]
        seen, asked, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for turn, (role, text) in enumerate(turns):
            f = fault(text, (role, text) in seen)
            faults[f] += 1
            seen.add((role, text))
            asked.append((role, text, f in ("blank", "duplicate"), f == "truncated"))
            rows.append((conv, turn * 2, role, text, 1))
        if not turns:
            rows.append((conv, 0, "user", "gone", 0))
        cost, audit, lines = cheapest(asked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(asked))
        want[conv] = (max(len(turns) - 1, 0), *list(faults.values())[:3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    draw.shuffle(rows)
    got = repair_summaries(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_edits_come_with_the_rows_that_they_leave(spark):
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "user", "Hi.", 1), (1, 2, "tool", "Well.", 1), (1, 3, "user", "And", 1)]
    got = sorted(map(tuple, repair_edits(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")).collect()))
    assert [r[2] for r in got] == list("KDRD")
    assert got[0][3:] == (0, "user", "Hi.") and got[1][3:] == (None, None, None) and got[2][3:] == (2, "assistant", "Well.")


def test_what_is_unresolved_stays_small():
    repair, edits = Repair(), 0
    for i in range(20_000):
        edits += sum(1 for _ in repair.feed((i, "user", "x."), "u" if i % 2 == 0 else "a", i % 7 == 3, i % 11 == 5))
    cost, rest = repair.finish()
    assert repair.most < 50 and len(rest) < 50 and edits + len(rest) >= 20_000
    blank = Repair()
    assert sum(1 for i in range(5000) for _ in blank.feed((i, "user", ""), "u", True, False)) > 4900 and blank.most < 50


def test_damage_nulls_ties_and_further_columns(spark):
    rows = [(None, None, None, None, 1), (3, None, "user", "A.", 1), (3, 1, "user", "A.", 1), (3, 1, "user", "A.", 1), (3, 1, "assistant", "B.", 1), (4, 9, None, "x", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seen int")
    got = {r.conv_id: r for r in repair_summaries(damaged(frame)).collect()}
    assert set(got) == {None, 3, 4}
    for conv, turn, role, text, _ in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        copies = [r.copies for r in damaged(frame).collect() if (r.conv_id, r.turn) == (conv, turn)]
        assert set(copies) == {0 if draw == 0 else 2 if draw == 3 else 1}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    assert sorted(con.execute(op12.ORACLE_SQL).fetchall(), key=str) == sorted((tuple(r) for r in got.values()), key=str)
    assert repair_summaries(damaged(frame.limit(0))).collect() == []


@pytest.mark.parametrize("module, table", [(op12, "conversations"), (op13, "embeddings")])
def test_queries_equal_their_sql(spark, module, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert sorted(map(tuple, module.query(spark, SF).collect())) == sorted(con.execute(module.ORACLE_SQL).fetchall())


# --- Centroid clustering ---------------------------------------------------------------------------------------------


def by_distances(vectors, k, rounds, dim):
    """Plain Python: vectors are (vec_id, integers)."""
    kept = sorted(vectors, key=lambda v: hashlib.sha256(f"3:{'' if v[0] is None else v[0]}".encode()).hexdigest())
    centres = [list(v) for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        own = [[v for _, v in vectors if nearest(v)[1] == i] for i in range(len(centres))]
        centres = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, centres)]
    return sorted(((i, *nearest(v)[::-1], tuple(centres[nearest(v)[1]])) for i, v in vectors), key=str)


def test_clusters_are_those_of_plain_distances(spark):
    draw = np.random.default_rng(2)
    good = [(i, [float(x) for x in draw.integers(-6, 6, 4) / 8]) for i in range(60)] + [(3, [0.5, 0.5, 0.5, 0.5]), (3, [0.5, 0.5, 0.5, 0.5])]
    bad = [(90, None), (91, [1.0, 2.0, 3.0]), (92, [1.0, None, 0.0, 0.0]), (93, [math.nan, 0.0, 0.0, 0.0]), (94, [math.inf, 0.0, 0.0, 0.0]), (95, [1e30, 0.0, 0.0, 0.0]), (96, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<float>, cluster int").repartition(5)
    got = sorted(((r.vec_id, r.cluster, r.distance, tuple(r.centroid)) for r in cluster_vectors(frame, 5, 4, 4).collect()), key=str)
    assert got == by_distances([(i, [math.floor(1024 * x) for x in v]) for i, v in good], 5, 4, 4)


def test_fewer_vectors_than_centroids_null_ids_and_none(spark):
    frame = spark.createDataFrame([(None, [1.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = cluster_vectors(frame, 8, 3, 2).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in got] == [(0, 0, 0), (0, 0, 0)]
    assert cluster_vectors(frame.limit(0), 8, 3, 2).collect() == []


def test_matches_are_exact_for_great_and_equal_vectors():
    game = Tournament([[1, 0], [0, 1], [-1, 0], [1, 0]])
    assert game.winners(np.array([[0, 0], [5, 5], [-3, 0], [9, 0]], np.int64)).tolist() == [0, 0, 2, 0]
    wide = (1 << 27) - 1
    great = Tournament([[wide, -wide], [wide, -wide + 1]])
    assert great.winners(np.array([[wide, wide], [wide, -wide], [-wide, -wide]], np.int64)).tolist() == [1, 0, 0]
