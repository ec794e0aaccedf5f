import struct

import pytest

from sufloom import __main__ as commands


def naive(text, k):
    return sorted(range(len(text) + 1), key=lambda i: (text[i:] if k < 0 else text[i : i + k], i))


def test_sort_build_and_query(spark, tmp_path, capsys):
    f = tmp_path / "x.fa"
    f.write_text(">a\nCCGNT\n>b\nacgtcc\nGT\n")
    text = "CCGATACGTCCGT"
    for k, algorithm in ((32, "PARALLEL_SORTING"), (2, "parallel_sorting"), (-1, "PREFIX_DOUBLING")):
        rows = commands.suffix_sort(spark, str(f), k, algorithm).orderBy("r").collect()
        assert [r["pos"] for r in rows] == naive(text, k)
    commands.main(["fmindex_build", str(f)])
    commands.main(["fmindex_query", str(f), "-q", "CCG", "-n", "1"])
    out = capsys.readouterr().out
    assert "2 occurrences" in out and "1st 0 CCG" in out
    commands.main(["fmindex_query", str(f), "-q", "ccg"])
    assert "2nd 9 CCG" in capsys.readouterr().out
    commands.main(["fmindex_build", str(f), "-k", "256", "-t", "2"])
    capsys.readouterr()
    with pytest.raises(SystemExit):
        commands.main(["suffix_sort", str(f), "-g"])
    b = tmp_path / "b.bin"
    b.write_bytes(struct.pack("<II", 2, 3) + b"CGGTTT")
    commands.main(["fmindex_query", str(f), "-b", str(b)])
    assert "5 occurrences, sum of positions 35" in capsys.readouterr().out


def test_patterns_longer_than_the_index(spark, tmp_path, capsys):
    import random

    from sufloom.operators import search, suffixes

    rng = random.Random(8)
    unit = "".join(rng.choice("ACGT") for _ in range(150))
    text = unit + unit[:140] + "A" * 120 + unit
    f = tmp_path / "x.fa"
    f.write_text(">a\n" + text + "\n")
    commands.main(["fmindex_build", str(f)])
    capsys.readouterr()

    def places(p):
        return [i for i in range(len(text)) if text.startswith(p, i)]

    for p in (unit[:33], unit[5:105], "A" * 64, "A" * 97, unit[-70:], unit[:64] + "C" * 40):
        commands.main(["fmindex_query", str(f), "-q", p])
        assert f"{len(places(p))} occurrences" in capsys.readouterr().out
    batch = [unit[:100], unit[50:150], "A" * 100, "C" * 100]
    b = tmp_path / "b.bin"
    b.write_bytes(struct.pack("<II", 100, len(batch)) + "".join(batch).encode())
    commands.main(["fmindex_query", str(f), "-b", str(b)])
    found = [i for p in batch for i in places(p)]
    assert f"{len(found)} occurrences, sum of positions {sum(found)}" in capsys.readouterr().out

    sa = suffixes.suffix_array(suffixes.suffixes(spark.createDataFrame([(0, text)], "seq_id long, text string"))).cache()
    wanted = [*batch, "A", unit[:32]]
    patterns = spark.createDataFrame(list(enumerate(wanted)), "pattern_id long, pattern string")
    assert {r["pattern_id"]: (r["n"], r["positions"]) for r in search.count(patterns, sa).collect()} == {i: (len(places(p)), sum(places(p))) for i, p in enumerate(wanted)}
    assert [r["pattern_id"] for r in search.without_match(patterns, sa).collect()] == [3]
    assert sorted(r["pattern_id"] for r in search.with_match(patterns, sa).collect()) == [0, 1, 2, 4, 5]
    with pytest.raises(ValueError):
        search.ranges(patterns, sa)
