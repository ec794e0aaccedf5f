"""The pipeline's stages against their operators and brute force, at the smallest scale."""

import corpus_pipeline
from sufloom.llm import near_dedup, op5, op7, secrets
from sufloom.llm.common import cut


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    good = cut(corpus_pipeline.quality(spark, docs, sf), "good")
    assert good.columns == columns
    assert ids(good) == ids(op5.judge(docs, labels).where("predicted = 1"))

    clean = cut(corpus_pipeline.toxicity(spark, good, sf), "clean")
    assert clean.columns == columns
    assert ids(clean) == ids(op7.judge(good, labels).where("predicted = 0"))

    apart = cut(corpus_pipeline.near_dedup(spark, clean, sf), "apart")
    assert apart.columns == columns
    assert ids(apart) == ids(near_dedup.near_duplicates(clean, width=5).where("kept"))

    masked = cut(corpus_pipeline.secrets(spark, apart, sf), "masked")
    assert masked.columns == columns and ids(masked) == ids(apart)
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (apart, masked))
    touched = {r["doc_id"] for r in secrets.scan(apart).where("size(found) > 0").select("scanned.doc_id").collect()}
    assert {i for i in before if before[i] != after[i]} == touched

    pieces = corpus_pipeline.packing(spark, masked, sf)
    assert sorted({r["doc_id"] for r in pieces.select("doc_id").collect()}) == ids(masked)


def test_run_is_the_stages_in_order(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "secrets", "packing"]
    full = out.groupBy("sequence_id").sum("length").toDF("s", "n")
    assert full.where("n > 1024").count() == 0 and full.count() > 10


def test_near_dedup_stage_decides_by_row(spark):
    """Null and repeated ids, against brute force over the rows."""
    import random

    import corpus_pipeline

    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(100)]
        for n in range(rng.randrange(1, 5)):
            text = base[:] if n % 2 else base[:-1] + [rng.choice(words)]
            rows.append((rng.choice([None, rng.randrange(12)]), " ".join(text)))
    rows += [(None, ""), (None, ""), (3, ""), (3, ""), (None, None), (7, rows[0][1]), (7, rows[5][1])]

    def shingles(text):
        w = (text or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    groups = {}
    for x, r, s in zip(label, rows, sets):
        if s:
            groups.setdefault(x, []).append(r)
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(r[0] is None for r in got if not r[1]) == [False, True, True, True]
    full = [r for r in got if r[1]]
    assert len(full) == len(groups) and any(r[0] is None for r in full)
    for g in groups.values():
        inside = [r for r in full if r in g]
        known = [i for i, _ in g if i is not None]
        assert len(inside) == 1 and inside[0][0] == (min(known) if known else None)
