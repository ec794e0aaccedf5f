import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from sufloom.llm import merges, op2, pieces, segments

PATH = public_tokenizers.path(op2.MODEL)
ODD = [None, "", " ", "a", " a  b   c ", "x\n y\n\n  z\t q", "des Elle", "”, x….", "▁ a▁▁", "日本 語é☃ \x00", "x" * 700, "ab" * 90 + " " * 90, "e☃" * 40, "<s> a </s> <0x41>", "12 3.5 a_b,c;d", "ﬁ 🙂🙂 word🙂"]


@pytest.fixture(scope="module")
def texts(spark, sf):
    rng = random.Random(7)
    out = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(150).collect()]
    out += ["".join(rng.choice("ab tehins  \n\té☃▁日本xX.=-’,") for _ in range(rng.randrange(300))) for _ in range(300)]
    return ODD + out + ODD


@pytest.fixture(scope="module")
def alone(texts):
    """Each text by the merges and by the scan, made by the two modules word after word."""
    m, p = merges.Merges(PATH), pieces.Pieces(PATH)
    return [(m.encode(t), p.encode(t)) for t in texts]


@pytest.mark.parametrize("most", [100 << 20, 50_000])
def test_parts_solved_together_equal_those_solved_alone(texts, alone, most):
    own = segments.Parts(pieces.pieces_of(PATH), merges.merges_of(PATH), most)
    for _ in range(2):
        for at in range(0, len(texts), 37):
            got = own.encoded(texts[at : at + 37])
            assert [(np.frombuffer(a, "<i4").tolist(), np.frombuffer(b, "<i4").tolist()) for a, b in zip(*got)] == alone[at : at + 37]
            assert len(own.number) == len(own.merged) == len(own.scanned) == len(own.total) == len(own.times)


def test_scores_and_lengths_of_parts():
    own, plain = segments.Parts(pieces.pieces_of(PATH), merges.merges_of(PATH)), pieces.Pieces(PATH)
    rng = random.Random(1)
    parts = ["".join(rng.choice("aehinrstABé") for _ in range(n)) for n in [*range(1, 70), *[6] * 300] for _ in range(3)]
    merged, scanned, total = own.solve(parts)
    for p, m, s, t in zip(parts, merged, scanned, total):
        assert (t, np.frombuffer(s, "<i4").tolist()) == plain.path_between(p, 0, len(p))
        assert np.frombuffer(m, "<i4").tolist() == own.merges.merge(p)


def test_a_table_of_numbers_finds_its_keys_only():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1000, 60_000):
        keys = rng.choice(10**12, n, replace=False).astype(np.int64)
        own = segments.Lookup(keys, np.arange(n, dtype=np.int32))
        assert own(keys).tolist() == list(range(n))
        assert (own(np.setdiff1d(rng.integers(0, 10**12, 5000), keys)) == -1).all()


@pytest.mark.parametrize("giant,chunk", [(32_768, 8_192), (50, 7), (300, 97)])
def test_one_pass_gives_both_of_small_and_giant_documents(docs_of, texts, alone, giant, chunk):
    got = segments.encode(docs_of(texts, extra=True), PATH, giant, chunk).orderBy("doc_id").collect()
    assert [(r["ids"], r["scan_ids"]) for r in got] == alone
    p = pieces.Pieces(PATH)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    rows = op2.both(docs_of(texts), PATH, giant, chunk).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == [(len(m), crc(m), zlib.crc32(p.decode(np.array(m)).encode()), len(s), crc(s)) for m, s in alone]


def test_op2_makes_both_in_one_pass_and_joins_nothing(docs_of):
    docs = docs_of(["a b", "c", "c"])
    plan = op2.both(docs, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 2
    assert sorted(map(tuple, op2.both(docs, PATH).collect())) == sorted(map(tuple, op2.joined(docs, PATH).collect()))
