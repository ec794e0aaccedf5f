import gzip
import random
import struct

import pytest

from sufloom.sources import datasource, files


@pytest.fixture(scope="module")
def sources(spark):
    datasource.register(spark)
    return spark


def batch(path, length, words):
    path.write_bytes(struct.pack("<II", length, len(words)) + "".join(words).encode())


def test_a_batch_is_read_by_many_tasks(sources, tmp_path):
    words = ["".join(random.Random(i).choices("ACGTacgtN", k=7)) for i in range(1000)]
    batch(tmp_path / "a.bin", 7, words)
    df = sources.read.format("patterns").option("splitBytes", 100).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == -(-1000 // 14)
    got = {r["pattern_id"]: r["pattern"] for r in df.collect()}
    folded = str.maketrans("acgt", "ACGT")
    assert got == {i: w.translate(folded) for i, w in enumerate(words)}
    whole = files.read_patterns(sources, str(tmp_path / "a.bin"))
    assert files.same_rows(df.select("pattern_id", "pattern"), whole)


def test_only_named_columns_are_made(sources, tmp_path):
    batch(tmp_path / "a.bin", 3, ["ACG", "TTT"])
    df = sources.read.format("patterns").schema("pattern_id long").load(str(tmp_path))
    assert df.columns == ["pattern_id"] and sorted(r[0] for r in df.collect()) == [0, 1]
    with pytest.raises(Exception, match="no such columns"):
        sources.read.format("patterns").schema("other long").load(str(tmp_path)).collect()


def test_empty_and_broken_batches(sources, tmp_path):
    batch(tmp_path / "none.bin", 3, [])
    (tmp_path / "_hidden").write_bytes(b"x")
    assert sources.read.format("patterns").load(str(tmp_path)).count() == 0
    (tmp_path / "short.bin").write_bytes(struct.pack("<II", 3, 5) + b"ACG")
    with pytest.raises(Exception, match="5 patterns of 3 characters"):
        sources.read.format("patterns").load(str(tmp_path)).collect()


def test_patterns_written_and_read(sources, tmp_path):
    words = ["ACG", "TT", "ACG", "GATTACA", "T" * 50]
    df = sources.createDataFrame([(w,) for w in words], "pattern string").repartition(3)
    out = str(tmp_path / "out")
    df.write.format("patterns").option("splitBytes", 8).mode("append").save(out)
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_")]
    assert sorted(r["pattern"] for r in sources.read.format("patterns").load("file://" + out).collect()) == sorted(words)
    with pytest.raises(Exception, match="null or empty"):
        sources.createDataFrame([("",)], "pattern string").write.format("patterns").mode("append").save(out)
    assert sources.read.format("patterns").load(out).count() == len(words)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_fasta_in_splits(sources, tmp_path, split):
    text = "junk\n>one some words\nACGT\nAC>GT\n\n>two\tx\r\nGG\r\nTT\r\n>three\n>four\nA"
    (tmp_path / "a.fa").write_bytes(text.encode())
    rows = {r["name"]: r["seq"] for r in sources.read.format("fasta").option("splitBytes", split).load(str(tmp_path)).collect()}
    assert rows == {"one": "ACGTAC>GT", "two": "GGTT", "three": "", "four": "A"}


def test_fasta_in_small_blocks(tmp_path, monkeypatch):
    from pyspark.sql.types import StringType, StructType

    monkeypatch.setattr(datasource.FastaReader, "block", 3)
    (tmp_path / "a.fa").write_bytes(b">a\nACGTACGT\r\nAC\n>b c\nG\n")
    schema = StructType().add("name", StringType()).add("seq", StringType())
    for split in range(1, 30):
        own = datasource.FastaReader(schema, {"path": str(tmp_path), "splitBytes": str(split)})
        assert [r for p in own.partitions() for r in own.read(p)] == [("a", "ACGTACGTAC"), ("b", "G")]


def test_fasta_gzip_names_and_none(sources, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">x y\nAC\nGT\n>z\n")
    read = sources.read.format("fasta").option("splitBytes", 2)
    assert sorted(map(tuple, read.load(str(tmp_path / "a.fa.gz")).select("name", "seq").collect())) == [("x", "ACGT"), ("z", "")]
    assert sorted(r["name"] for r in read.schema("name string").load(str(tmp_path)).collect()) == ["x", "z"]
    (tmp_path / "none").mkdir()
    assert sources.read.format("fasta").load(str(tmp_path / "none")).count() == 0


def test_small_splits_of_much_data_are_no_task_each(sources, tmp_path, monkeypatch):
    from pyspark.sql.types import StringType, StructType

    words = ["".join(random.Random(i).choices("ACGT", k=12)) for i in range(5000)]
    for i in range(5):
        batch(tmp_path / f"{i}.bin", 12, words[i * 1000 : i * 1000 + 1000])
    monkeypatch.setattr(datasource, "MOST", 20)
    own = datasource.PatternReader(StructType().add("pattern", StringType()), {"path": str(tmp_path), "splitBytes": "16"})
    splits = own.partitions()
    assert 5 <= len(splits) <= 20 + 5
    assert [x for s in splits for b in own.read(s) for x in b.column("pattern").to_pylist()] == words
