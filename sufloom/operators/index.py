"""Tables that a suffix array gives: character counts, occurrence ranks, samples, bitmap, lookup.

sa is (seq_id, r, pos, p, bwt) of DNA texts. The C table counts 1 for the empty suffix; the primary row (pos 0) has no
bwt character and counts for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sufloom.sources.scratch import discard, materialize

LETTERS = ("A", "C", "G", "T")


def c_table(sa: DataFrame) -> DataFrame:
    """seq_id, n (rows), c_A .. c_T: 1 + how many characters are smaller."""
    sums = sa.groupBy("seq_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("bwt") == c).alias(f"n_{c}") for c in LETTERS))
    out, below = ["seq_id", "n"], F.lit(1).cast("long")
    for c in LETTERS:
        out.append(below.alias(f"c_{c}"))
        below = below + F.col(f"n_{c}")
    return sums.select(*out)


def occurrence_ranks(sa: DataFrame) -> DataFrame:
    """seq_id, r, o_A .. o_T: how often each character stands in bwt before row r; one more row after the last."""
    before = Window.partitionBy("seq_id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    end = sa.groupBy("seq_id").agg((F.max("r") + 1).alias("r")).select("seq_id", "r", F.lit(None).cast("string").alias("bwt"))
    rows = sa.select("seq_id", "r", "bwt").unionByName(end)
    return rows.select("seq_id", "r", *(F.coalesce(F.sum((F.col("bwt") == c).cast("long")).over(before), F.lit(0)).alias(f"o_{c}") for c in LETTERS))


def occurrence_checkpoints(sa: DataFrame, every: int = 256) -> DataFrame:
    """occurrence_ranks at each multiple of `every`: sums of blocks, and running sums of those."""
    blocks = sa.groupBy("seq_id", F.expr(f"r div {every}").alias("b")).agg(*(F.count_if(F.col("bwt") == c).alias(f"n_{c}") for c in LETTERS))
    sums = running_sums(blocks, [f"n_{c}" for c in LETTERS])
    return sums.select("seq_id", (F.col("b") * every).alias("r"), *(F.col(f"n_{c}").alias(f"o_{c}") for c in LETTERS))


def sampled(sa: DataFrame, interval: int = 4) -> DataFrame:
    """seq_id, r, pos of the rows whose position is a multiple of interval."""
    return sa.where(F.col("pos") % interval == 0).select("seq_id", "r", "pos")


def sample_bitmap(sa: DataFrame, interval: int = 4, width: int = 64) -> DataFrame:
    """seq_id, b (block of `width` rows), n (sampled rows in it), before (sampled rows ahead of it)."""
    blocks = sa.groupBy("seq_id", F.expr(f"r div {width}").alias("b")).agg(F.count_if(F.col("pos") % interval == 0).alias("n"))
    return blocks.join(running_sums(blocks, ["n"]).withColumnRenamed("n", "before"), ["seq_id", "b"])


def kmer_lookup(sa: DataFrame, length: int = 4) -> DataFrame:
    """seq_id, kmer, beg, end: the row range of each k-mer that occurs."""
    rows = sa.where(F.length("p") >= length).groupBy("seq_id", F.substring("p", 1, length).alias("kmer"))
    return rows.agg(F.min("r").alias("beg"), (F.max("r") + 1).alias("end"))


def primary_rows(sa: DataFrame) -> DataFrame:
    return sa.where("pos = 0").select("seq_id", F.col("r").alias("primary_row"))


def transform_blocks(sa: DataFrame, width: int = 64) -> DataFrame:
    """seq_id, b, bwt, o_A .. o_T: the transform in blocks of `width` rows, $ at the primary row, with how often each
    character stands before the block; one more, empty block where the last one is full."""
    rows = sa.groupBy("seq_id", F.expr(f"r div {width}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("r", F.coalesce("bwt", F.lit("$")).alias("c")))).alias("x"))
    blocks = rows.select("seq_id", "b", F.array_join(F.col("x.c"), "").alias("bwt"))
    full = blocks.groupBy("seq_id").agg(F.max_by(F.struct((F.col("b") + 1).alias("b"), F.length("bwt").alias("size")), "b").alias("x")).where(f"x.size = {width}")
    blocks = blocks.unionByName(full.select("seq_id", "x.b", F.lit("").alias("bwt")))
    counts = blocks.select("seq_id", "b", *((F.length("bwt") - F.length(F.replace(F.col("bwt"), F.lit(c)))).cast("long").alias(f"n_{c}") for c in LETTERS))
    before = running_sums(counts, [f"n_{c}" for c in LETTERS])
    return blocks.join(before, ["seq_id", "b"]).select("seq_id", "b", "bwt", *(F.col(f"n_{c}").alias(f"o_{c}") for c in LETTERS))


def running_sums(rows: DataFrame, columns: list[str], span: int = 4096) -> DataFrame:
    """rows (seq_id, b, columns) with each column replaced by its sum over the text's earlier blocks: sums of spans of
    blocks first, then within each span, so that one long text is many groups."""
    spanned = rows.withColumn("span", F.expr(f"b div {span}"))
    ahead = Window.partitionBy("seq_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = spanned.groupBy("seq_id", "span").agg(*(F.sum(c).alias(c) for c in columns))
    totals = totals.select("seq_id", "span", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"base_{c}") for c in columns))
    inside = Window.partitionBy("seq_id", "span").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    within = spanned.select("seq_id", "span", "b", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in columns))
    return within.join(totals, ["seq_id", "span"]).select("seq_id", "b", *((F.col(c) + F.col(f"base_{c}")).cast("long").alias(c) for c in columns))


def bwt_text(sa: DataFrame, width: int = 4096) -> DataFrame:
    """seq_id, bwt: the transform of each text as one string, $ at the primary row; for texts that fit a row. Rows are
    joined in blocks first."""
    rows = sa.groupBy("seq_id", F.expr(f"r div {width}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("r", F.coalesce("bwt", F.lit("$")).alias("c")))).alias("x"))
    blocks = rows.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("b", F.array_join(F.col("x.c"), "").alias("s")))).alias("x"))
    return blocks.select("seq_id", F.array_join(F.col("x.s"), "").alias("bwt"))


def invert(sa: DataFrame, max_rounds: int = 40) -> DataFrame:
    """seq_id, pos, c of the texts, from (seq_id, r, bwt) alone: LF steps, doubled in each round by joining the mapping
    with itself, give every row its distance from the primary row."""
    w = Window.partitionBy("seq_id", "bwt").orderBy("r")
    counts = c_table(sa)
    base = F.coalesce(*(F.when(F.col("bwt") == c, F.col(f"c_{c}")) for c in LETTERS))
    lf = sa.select("seq_id", "r", "bwt").join(counts, "seq_id").withColumn("to", F.when(F.col("bwt").isNotNull(), base + F.row_number().over(w) - 1))
    # steps: LF steps from r to the primary row once `to` is null
    now = materialize(lf.select("seq_id", "r", "bwt", "to", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("steps")), "inverse")
    for _ in range(max_rounds):
        if now.where("to is not null").isEmpty():
            return now.where("bwt is not null").select("seq_id", (F.col("steps") - 1).alias("pos"), F.col("bwt").alias("c"))
        jump = now.select("seq_id", F.col("r").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        joined = now.join(jump, ["seq_id", "to"], "left")
        old = now
        now = materialize(joined.select("seq_id", "r", "bwt", F.col("to2").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")), "inverse")
        discard(old)
    raise RuntimeError("the inversion did not end")


def build_tables(sa: DataFrame, interval: int = 4, width: int = 64, length: int = 4) -> dict[str, DataFrame]:
    """The tables that files.save_index writes."""
    return {
        "sa": sa, "c_table": c_table(sa), "sampled": sampled(sa, interval), "bitmap": sample_bitmap(sa, interval), "lookup": kmer_lookup(sa, length),
        "transform": transform_blocks(sa, width), "primary": primary_rows(sa),
    }
