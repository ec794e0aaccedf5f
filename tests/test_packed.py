"""Packed order with refined ties, the scan for LMS positions, search by transforms, and the index folder."""

import random

import pytest
from pyspark.sql import functions as F

from sufloom import __main__ as commands
from sufloom.operators import in_place, index, merge, packed, search, suffixes
from sufloom.sources import files

rng = random.Random(3)
UNIT = "".join(rng.choices("ACGT", k=300))
TEXTS = {
    1: "A" * 900, 2: "".join(rng.choices("ACGT", k=700)), 3: UNIT + "A" * 40 + UNIT + "GC" + UNIT, 4: "ACG" * 200, 5: "C", 6: "".join(rng.choices("AC", k=512)), 7: "A" * 500 + "C", 8: "T" * 256,
}
FEW = {s: TEXTS[s] for s in (3, 7)}


def naive(text, k):
    return sorted(range(len(text) + 1), key=lambda i: (text[i:] if k is None else text[i : i + k], i))


def places(word, text):
    return [i for i in range(len(text) - len(word) + 1) if text.startswith(word, i)]


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "seq_id long, text string")


@pytest.mark.parametrize("k", [10, 32, 100, 256, None])
def test_packed_order_of_many_texts_over_partitions_that_cut_groups_of_ties(spark, monkeypatch, k):
    monkeypatch.setattr(packed, "ROWS_EACH", 300)
    counts, by = [], {}
    for r in packed.unpacked(packed.ordered(packed.blocks_of(frame(spark, TEXTS)), k, False, counts)).collect():
        by.setdefault(r["seq_id"], {})[r["r"]] = r
    for s, t in TEXTS.items():
        order = naive(t, k)
        assert [by[s][i]["pos"] for i in range(len(order))] == order
        size = min(k or 32, 32)
        assert [(by[s][i]["p"], by[s][i]["bwt"]) for i in range(len(order))] == [(t[i : i + size], t[i - 1] if i else None) for i in order]
    assert counts == sorted(counts, reverse=True) and counts[0] == sum(map(len, TEXTS.values())) + 1
    if k is None:
        assert len(counts) >= 5 and counts[-1] < counts[1]


@pytest.mark.parametrize("k", [33, 63, 64, 65, 256, None])
def test_the_first_sort_compares_64_characters(spark, monkeypatch, k):
    """Few suffixes go on to the refinement where most tie on 32 characters."""
    monkeypatch.setattr(packed, "ROWS_EACH", 100)
    own = random.Random(9)
    text = "".join("A" * 33 + own.choice("CGT") + own.choice("ACGT") * 3 + "".join(own.choices("ACGT", k=20)) for _ in range(30)) + "A" * 40
    counts = []
    found = packed.ordered(packed.blocks_of(frame(spark, {0: text})), k, True, counts)
    assert [r["pos"] for r in found.orderBy("r").collect()] == naive(text, k)
    tied = [i for i in range(len(text)) if sum(text.startswith(text[i : i + 32], j) for j in range(len(text) - 31)) > 1]
    assert len(tied) > 50 and counts[1:] in ([], [0])


def test_rounds_of_doubling_leave_no_asked_ranks_on_disk(spark):
    from pathlib import Path

    from sufloom.sources.scratch import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    before, counts = len(list(folder.glob("ahead-*"))), []
    found = packed.ordered(packed.blocks_of(frame(spark, {0: TEXTS[3] + TEXTS[1]})), None, True, counts)
    assert len(counts) > 2 and len(list(folder.glob("ahead-*"))) == before
    assert [r["pos"] for r in found.orderBy("r").collect()] == naive(TEXTS[3] + TEXTS[1], None)


def test_one_text_and_what_is_no_nucleotide(spark):
    blocks = packed.blocks_of(frame(spark, {0: TEXTS[3]}))
    assert [r["pos"] for r in packed.ordered(blocks, None).orderBy("r").collect()] == naive(TEXTS[3], None)
    for k in (32, 256, None):  # no ties at all
        assert [r["pos"] for r in packed.ordered(packed.blocks_of(frame(spark, {0: TEXTS[2]})), k).orderBy("r").collect()] == naive(TEXTS[2], k)
    with pytest.raises(Exception, match="alone"):
        packed.ordered(packed.blocks_of(frame(spark, {0: "ACGN"})), 32).collect()


def test_lms_of_blocks_over_partitions_of_one_run(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "TASK_CHARACTERS", 256)
    for text in (TEXTS[2], "C" * 700 + "A" * 1200 + "G" * 300 + TEXTS[4], "A" * 800, "TA" * 300):
        c = suffixes.concatenated(frame(spark, {0: text}), "seq_id")
        want = [i for i in range(1, len(text)) if text[i - 1] > text[i] and next((x for x in text[i:] if x != text[i]), "") > text[i]]
        got = sorted((r["pos"], r["c"]) for r in suffixes.lms_of_blocks(c).collect())
        assert got == [(i, text[i]) for i in want] + [(len(text), None)]


@pytest.mark.parametrize("interval", [1, 4, 16])
def test_matches_and_positions_by_transforms(spark, interval):
    texts = frame(spark, {**TEXTS, 9: ""})
    t = suffixes.transforms(texts, None, interval).cache()
    lookup = index.kmer_lookup(suffixes.arrays(texts, None, 4), 4)
    words = ["", "C", "CA", "ACG", "ACGA", UNIT[5:60], UNIT[:150], UNIT[:40] + "CCGT", "A" * 45, "A" * 901, "ANA", "TTTTTTTT"]
    p = spark.createDataFrame([*enumerate(words), (77, None)], "pattern_id int, pattern string")
    ranges = in_place.matching_texts(p, lookup, t).cache()
    want = {(i, s): len(places(w, x)) if w else len(x) + 1 for i, w in enumerate(words) for s, x in [*TEXTS.items(), (9, "")]}
    assert {(r["pattern_id"], r["seq_id"]): r["end"] - r["beg"] for r in ranges.collect()} == {k: n for k, n in want.items() if n}
    got = {}
    for r in in_place.located(ranges.where("pattern_id > 0"), t).collect():
        got.setdefault((r["pattern_id"], r["seq_id"]), []).append(r["pos"])
    assert {k: sorted(v) for k, v in got.items()} == {(i, s): places(w, x) for i, w in enumerate(words) for s, x in TEXTS.items() if w and places(w, x)}


@pytest.mark.parametrize("stop", [0, 20])
def test_steps_in_place_equal_steps_by_blocks(spark, stop):
    texts = frame(spark, TEXTS)
    sa = suffixes.arrays(texts, None).cache()
    p = spark.createDataFrame(list(enumerate(["C", "", "CAG", "AAAAC", "NA"])), "pattern_id int, pattern string")
    by_blocks = search.backward_search(p, index.c_table(sa), index.transform_blocks(sa), stop)
    assert sorted(in_place.every_text(p, suffixes.transforms(texts), stop).collect()) == sorted(by_blocks.collect())


def test_an_array_ordered_by_few_characters_is_refused_for_steps(spark, tmp_path):
    path = str(tmp_path / "index")
    sa = suffixes.arrays(frame(spark, FEW), 32).cache()
    files.save_index(index.build_tables(sa), path)
    with pytest.raises(ValueError, match="ordered by 32"):
        files.load_index(spark, path, order=None)
    assert files.load_index(spark, path, order=32)["sa"].count() == sa.count()


def test_a_failed_build_leaves_the_index_that_was_there(spark, tmp_path):
    f = tmp_path / "x.fa"
    f.write_text(">a\n" + TEXTS[3] + "\n")
    folder = commands.fmindex_build(spark, str(f))
    before = files.index_manifest(spark, folder).collect()
    f.write_text(">a\nACGTNNACGT\n")
    with pytest.raises(Exception, match="other characters"):
        commands.fmindex_build(spark, str(f), strict=True)
    assert files.index_manifest(spark, folder).collect() == before
    assert files.load_index(spark, folder, check=True)["sa"].count() == len(TEXTS[3]) + 1
    other = tmp_path / "y.fa"
    other.write_text(">b\n" + TEXTS[3] + "\n")
    assert files.same_index(spark, folder, commands.fmindex_build(spark, str(other)))
    other.write_text(">b\nACGT\n")
    assert not files.same_index(spark, folder, commands.fmindex_build(spark, str(other)))


def test_positions_on_the_index_that_the_command_saves(spark, tmp_path):
    f = tmp_path / "x.txt"
    f.write_text(TEXTS[3] + "\n" + TEXTS[7] + "\n")
    text = TEXTS[3] + TEXTS[7]
    tables = files.load_index(spark, commands.fmindex_build(spark, str(f)), order=None)
    words = ["AAAA", UNIT[:42], "A" * 44, "GC", "C" * 50]
    p = spark.createDataFrame(list(enumerate(words)), "pattern_id int, pattern string")
    ranges = search.backward_search(p, tables["c_table"], tables["transform"])
    got = search.located(ranges, tables["c_table"], tables["transform"], tables["sampled"]).groupBy("pattern_id").agg(F.sort_array(F.collect_list("pos")).alias("x")).collect()
    assert {words[r["pattern_id"]]: r["x"] for r in got} == {w: places(w, text) for w in words if places(w, text)}


@pytest.mark.parametrize("small", [None, 0])
def test_a_batch_merged_with_the_array(spark, small):
    texts = frame(spark, {**TEXTS, 9: ""})
    words = ["A", "AC", "ACG", "ACGA", "", UNIT[5:60], UNIT[:290], UNIT[:40] + "CCGT", "A" * 33, "A" * 31 + "C", "TTTT", "Z", "A" * 901, UNIT[7:15], UNIT[7:15]]
    p = spark.createDataFrame([*enumerate(words), (77, None)], "pattern_id int, pattern string")
    got = {}
    for r in merge.batch_matches(p, suffixes.arrays(texts, 32), texts, 32, small).collect():
        assert r["pattern"] == words[r["pattern_id"]]
        got.setdefault((r["pattern_id"], r["seq_id"]), []).append(r["pos"])
    want = {(i, s): places(w, x) if w else list(range(len(x) + 1)) for i, w in enumerate(words) for s, x in [*TEXTS.items(), (9, "")]}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_a_step_shuffles_no_part_of_the_saved_transform(spark, tmp_path):
    path = str(tmp_path / "index")
    sa = suffixes.arrays(frame(spark, FEW), None, 32).cache()
    files.save_index(index.build_tables(sa), path, order=None)
    tables = files.load_index(spark, path, ("c_table", "transform"), order=None)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = spark.createDataFrame([(0, "C")], "pattern_id int, pattern string")
        whole = spark.createDataFrame([(0, s, 0, len(t) + 1) for s, t in FEW.items()], "pattern_id int, seq_id long, beg long, end long")
        found = search.backward_search(p, tables["c_table"], tables["transform"], 0, whole)
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
        assert {r["seq_id"]: r["end"] - r["beg"] for r in found.collect()} == {s: t.count("C") for s, t in FEW.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scans = [i for i, x in enumerate(lines) if "Bucketed: true" in x]
    assert len(scans) == 2  # for the first and for the last row
    for i in scans:  # a sort, a projection and a filter stand between the join and the scan, and no exchange
        assert "Sort [" in lines[i - 3] and not any("Exchange" in x for x in lines[i - 3 : i])
