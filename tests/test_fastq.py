"""FASTQ by splits against a plain parser, with records of many lines and qualities that look like names."""

import random

import pytest

from sufloom.sources import files


def plain(text):
    out, lines, i = [], text.splitlines(), 0
    while i < len(lines):
        if not lines[i].startswith("@"):
            i += 1
            continue
        name, seq, qual, i = lines[i][1:].replace("\t", " ").split(" ")[0], "", "", i + 1
        while i < len(lines) and not lines[i].startswith("+"):
            seq, i = seq + lines[i], i + 1
        i += 1
        while i < len(lines) and len(qual) < len(seq):
            qual, i = qual + lines[i], i + 1
        out.append((name, seq, qual))
    return sorted(out)


def made(rng, n, width):
    out = ["no record", ""]
    for i in range(n):
        seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 7, 40, 333])))
        qual = "".join(rng.choices("@+IF#", k=len(seq)))
        cut = lambda x: [x[a : a + width] for a in range(0, len(x), width)]
        out += [f"@r{i} more\tto come", *cut(seq), "+" + (f"r{i}" if i % 2 else ""), *cut(qual)]
        if i % 9 == 0:
            out.append("")
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("size", ["100", "1000", "128m"])
def test_records_by_splits(spark, tmp_path, size):
    rng = random.Random(6)
    texts = [made(rng, 60, 20), made(rng, 10, 1000), made(rng, 25, 3)[:-5], "", "@only\nACGT\n+\n@+"]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.fq").write_text(t)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = files.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, got)) == sorted(x for t in texts for x in plain(t))
