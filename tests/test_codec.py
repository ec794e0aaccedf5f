from pyspark.sql import functions as F

from sufloom.functions import codec


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


def test_normalize_folds_case_lines_and_other_characters(spark):
    assert one(spark, "acgtN\nxß-TT", codec.normalize_dna) == "ACGTAAAATT"
    assert one(spark, None, codec.normalize_dna) is None
    assert one(spark, "", codec.normalize_dna) == ""


def test_codes_and_complement(spark):
    assert one(spark, "aCgTn?", codec.to_codes) == "012344"
    assert one(spark, "01234", codec.to_chars) == "ACGTN"
    assert one(spark, "aCgTn", codec.reverse_complement) == "NACGT"
    assert one(spark, "ACGT", codec.is_valid) is True
    assert one(spark, "ACGN", codec.is_valid) is False
    assert one(spark, "", codec.is_valid) is False


def test_key_and_back(spark):
    for s in ("A", "ACGT", "TTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT"):
        key = one(spark, s, codec.sequence_key)
        assert key == int("".join("ACGT".index(c).__str__() for c in s), 4)
        back = spark.createDataFrame([(key,)], "k long").select(codec.sequence_of(F.col("k"), len(s))).first()[0]
        assert back == s
    assert one(spark, "", codec.sequence_key) == 0
    assert one(spark, "C", lambda c: codec.prefix_key(c, 3)) == 16


def test_ordinals(spark):
    rows = spark.range(1, 124).select("id", codec.ordinal(F.col("id")).alias("o")).collect()
    at = {r["id"]: r["o"] for r in rows}
    assert [at[i] for i in (1, 2, 3, 4, 11, 12, 13, 19, 21, 22, 101, 111, 112, 123)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "19th", "21st", "22nd", "101st", "111th", "112th", "123rd"]


def test_windows_pack_and_unpack_whole_texts(spark):
    from pyspark.sql import functions as F

    from sufloom.functions import codec

    texts = ["", "T", "ACGT" * 8, "T" * 31, "T" * 32, "GATTACA" * 700, "A" * 1984 + "C"]
    rows = codec.windows(spark.createDataFrame(list(enumerate(texts)), "seq_id long, text string"))
    rows = rows.select("seq_id", "w", codec.sequence_of(codec.sequence_key(F.col("s")), F.length("s")).alias("s")).collect()
    back = {}
    for r in sorted(rows):
        assert len(r["s"]) <= 31 and r["w"] == len(back.setdefault(r["seq_id"], []))
        back[r["seq_id"]].append(r["s"])
    assert ["".join(back[i]) for i in range(len(texts))] == texts
