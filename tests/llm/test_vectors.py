import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from sufloom.llm import embedding_dedup as ed
from sufloom.llm import op4, op10
from sufloom.llm.topk_search import top_k


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    centre = rng.standard_normal(16)
    rows += [(300 + i, (centre + 0.22 * rng.standard_normal(16) * (1 + i % 3)).tolist()) for i in range(150)]
    rows += [(450 + i, rows[0][1]) for i in range(5)]
    rows += [(460, (2.5 * np.array(rows[1][1])).tolist()), (461, None), (462, [0.0] * 16), (463, [None] + [1.0] * 15), (464, [float("nan")] + [1.0] * 15), (465, [float("inf")] + [1.0] * 15), (466, [1.0]), (467, [])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("row", F.lit("x"))


def test_links_equal_brute_force(spark, vectors):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ed.near_duplicate_vectors(frame(spark, vectors), 0.9, block_rows=32).collect()}
    good = [(i, np.array(v)) for i, v in vectors if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in good]
    u = np.stack([v / np.sqrt((v * v).sum()) for _, v in good])
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    degree = dict(zip(ids, link.sum(axis=1).tolist()))
    found, true = sum(got[i][0] for i in ids), sum(degree.values())
    assert true > 1000 and 0.98 * true <= found <= true
    assert all(got[i][0] <= degree[i] for i in ids)
    own = {i: i for i in ids}
    for _ in range(len(ids)):
        before = dict(own)
        for a, b in zip(*np.nonzero(link)):
            own[ids[a]] = min(own[ids[a]], own[ids[b]])
        if before == own:
            break
    assert np.mean([got[i][1] == own[i] for i in ids]) >= 0.98
    for i in (461, 462, 463, 464, 465, 466, 467):
        assert got[i] == (0, i, True)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    left, right = ed.half_codes(32, 128, 7), ed.half_codes(32, 128, 8)
    cap = ed.cap_for(left, right, 64, 64.0)
    x = rng.standard_normal((600, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    z = rng.standard_normal((600, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.sqrt((z * z).sum(axis=1, keepdims=True))
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    a, b = ed.decode(x, left, right, cap), ed.decode(y, left, right, cap)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) >= 0.97


def test_list_decoding_finds_all_filters_above_the_cap():
    left, right = ed.half_codes(4, 16, 1), ed.half_codes(4, 16, 2)
    x = np.random.default_rng(0).standard_normal((50, 8))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    for row, got in zip(x, ed.decode(x, left, right, 0.2, least=0)):
        every = ((left @ row[:4])[:, None] + (right @ row[4:])[None, :]) / np.sqrt(2)
        assert got.tolist() == np.flatnonzero(every.ravel() >= 0.2).tolist()


def test_no_vectors(spark):
    none = frame(spark, [(1, None)]).limit(0)
    assert ed.near_duplicate_vectors(none).count() == 0
    assert top_k(none, F.col("vec_id") % 100 == 0).count() == 0
    assert [tuple(r) for r in ed.near_duplicate_vectors(frame(spark, [(1, None), (None, [1.0])])).orderBy("vec_id").collect()] == [(None, 0, None, True), (1, 0, 1, True)]


def test_top_k_equals_brute_force(spark, vectors):
    rows = [(i, v) for i, v in vectors if i != 466] + [(None, [1.0] * 16)]
    got = {}
    for r in top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, k=7, scale=8, block_rows=20, query_rows=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    good = {i: [int(np.floor(8 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in good if i % 50 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q))[:7]
        assert [got[q][k + 1] for k in range(7)] == [(i, -s) for s, i in best]


def test_bounds_of_single_queries_leave_few_annuli_of_clustered_vectors(spark):
    draw = np.random.default_rng(8)
    centres = draw.standard_normal((12, 16))
    centres *= 6 / np.sqrt((centres**2).sum(axis=1, keepdims=True))
    rows = [(i, (centres[i % 12] + draw.standard_normal(16) * 0.1).tolist()) for i in range(3000)]
    stats = {}
    got = top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, k=5, scale=64, block_rows=50, query_rows=8, stats=stats).collect()
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    for q in range(0, 3000, 100):
        scores = x @ x[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert stats["searched"] < 0.35 * stats["pairs"], stats


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    got = [tuple(r) for r in top_k(frame(spark, rows), F.col("vec_id") == 0, k=10, scale=4).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 8), (0, 2, 2, 8)]


@pytest.mark.parametrize("op", [op4, op10])
def test_queries_equal_sql(spark, sf, op):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(op.ORACLE_SQL).df()
    got = op.query(spark, sf).toPandas()[want.columns.tolist()]
    order = want.columns.tolist()
    assert got.astype("int64").sort_values(order).values.tolist() == want.astype("int64").sort_values(order).values.tolist()
