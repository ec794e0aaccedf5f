import gzip
import struct

from sufloom.operators import index, suffixes
from sufloom.sources import files
from sufloom.streaming import patterns as streams


def test_fasta(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_text(">one some words\nACGT\nAC\n>two\tx\nGG\r\nTT\n>three\n")
    rows = {r["name"]: r["seq"] for r in files.read_fasta(spark, str(f)).collect()}
    assert rows == {"one": "ACGTAC", "two": "GGTT", "three": ""}
    assert [r["seq"] for r in files.read_sequence(spark, str(f)).orderBy("file", "block", "line").collect()] == ["ACGT", "AC", "GG", "TT"]


def test_fasta_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">x\nAC\nGT\n")
    assert files.read_fasta(spark, str(tmp_path / "a.fa.gz")).first()["seq"] == "ACGT"


def test_fastq_with_several_lines_and_at_signs_in_the_quality(spark, tmp_path):
    f = tmp_path / "a.fq"
    f.write_text("@r1 first\nACG\nT\n+\n@@I\n+\n@r2\nAC\n+r2\nII\n")
    assert {(r["name"], r["seq"], r["qual"]) for r in files.read_fastq(spark, str(f)).collect()} == {("r1", "ACGT", "@@I+"), ("r2", "AC", "II")}


def test_plain_text(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("ACG\nTT\n")
    assert [r["seq"] for r in files.read_sequence(spark, str(f)).collect()] == ["ACG", "TT"]


def test_pattern_batch(spark, tmp_path):
    f = tmp_path / "p.bin"
    f.write_bytes(struct.pack("<II", 3, 2) + b"ACGTTT")
    assert [(r["pattern_id"], r["pattern"]) for r in files.read_patterns(spark, str(f)).orderBy("pattern_id").collect()] == [(0, "ACG"), (1, "TTT")]
    f2 = tmp_path / "none.bin"
    f2.write_bytes(struct.pack("<II", 3, 0))
    assert files.read_patterns(spark, str(f2)).count() == 0


def test_list_fields_and_validation(spark):
    import pytest
    from pyspark.sql import functions as F
    from sufloom.functions.codec import validated

    df = spark.createDataFrame([(["a", "", "b"],), ([],)], "x array<string>")
    assert [r["y"] for r in df.select(files.split_fields(files.join_fields(F.col("x"))).alias("y")).collect()] == [["a", "", "b"], []]
    good, bad = spark.createDataFrame([("ACG",), ("",)], "t string"), spark.createDataFrame([("ACN",)], "t string")
    assert good.select(validated(F.col("t"))).count() == 2
    with pytest.raises(Exception, match="other characters"):
        bad.select(validated(F.col("t"))).collect()


def test_records_and_headers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", 2.5), (2, "y", 0.5)], "a int, b string, c double")
    files.write_records(rows, str(tmp_path / "r"))
    assert files.same_rows(rows, files.read_records(spark, str(tmp_path / "r"), "a int, b string, c double"))
    head, body = files.split_header(spark.createDataFrame([("#h",), ("@i",), ("row",)], "value string"))
    assert head.count() == 2 and body.first()["value"] == "row"


def test_index_tables_survive_saving(spark, tmp_path):
    texts = spark.createDataFrame([(1, "ACGTACGT"), (2, "")], "seq_id long, text string")
    tables = index.build_tables(suffixes.suffix_array(suffixes.suffixes(texts, 32)))
    files.save_index(tables, str(tmp_path / "i"))
    loaded = files.load_index(spark, str(tmp_path / "i"))
    assert all(files.same_rows(tables[n].select(*loaded[n].columns), loaded[n]) for n in tables)


def test_stream_of_patterns(spark, tmp_path):
    texts = spark.createDataFrame([(1, "ACGTACGA")], "seq_id long, text string")
    sa = suffixes.suffix_array(suffixes.suffixes(texts, 32)).cache()
    spark.createDataFrame([(0, "ACG"), (1, "TA"), (2, "GGG")], "pattern_id int, pattern string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pattern_id int, pattern string").parquet(str(tmp_path / "in"))
    q = streams.counts_per_batch(streams.match_stream(stream, sa, (2, 3)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r["pattern_id"], r["pos"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0), (0, 4), (1, 3)]
