"""Commands on sequence files: suffix_sort, fmindex_build, fmindex_query.

    python -m sufloom suffix_sort FILE [-k 256] [-s PARALLEL_SORTING|PREFIX_DOUBLING]
    python -m sufloom fmindex_build FILE [-k 32]
    python -m sufloom fmindex_query FILE [-q PATTERN] [-n 10] [-b BATCH]

The records of a FASTA file, or the lines of a text file, are joined in file order; what isn't a nucleotide counts as A.
"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sufloom.functions.codec import normalize_dna, ordinal, validated
from sufloom.operators import index, packed, search, suffixes
from sufloom.sources import files
from sufloom.sources.scratch import materialize

VERSION = "0.2"


def joined_blocks(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    seq = F.col("seq")
    if strict:  # checked before anything is folded
        seq = validated(F.upper(seq))
    lines = files.read_sequence(spark, path).select("file", "block", "line", normalize_dna(seq).alias("text"))
    return materialize(suffixes.concatenated(lines, "file", "block", "line"), "blocks")


def suffix_sort(spark: SparkSession, path: str, k: int = 256, algorithm: str = "PARALLEL_SORTING", counts: list[int] | None = None) -> DataFrame:
    """seq_id 0, r, pos, by packed characters and a refinement of ties. PREFIX_DOUBLING, and -1 or k of more than 256, refine by
    doubling. counts takes the number of suffixes that each round ranks."""
    blocks = joined_blocks(spark, path).select(F.lit(0).cast("long").alias("seq_id"), "block", "text")
    doubling = algorithm.upper() == "PREFIX_DOUBLING" and not 0 < k <= packed.WORD
    depth = None if k < 0 or doubling and k <= packed.CHUNK else k
    return packed.ordered(blocks, depth, True, counts).select("seq_id", "r", "pos")


def fmindex_build(spark: SparkSession, path: str, strict: bool = False, interval: int = 4) -> str:
    """Writes the index tables, ordered by whole suffixes, and the text's blocks; returns their folder. strict: text of other
    characters than nucleotides is an error, and the index that is there stays."""
    out = f"{path}.index"
    blocks = joined_blocks(spark, path, strict)
    sa = materialize(suffixes.array_of_blocks(blocks, None), "sa")
    files.save_index({**index.build_tables(sa, interval), "blocks": blocks}, out, order=None, interval=interval)
    return out


def located(spark: SparkSession, path: str, patterns: DataFrame) -> DataFrame:
    """Matches of the patterns in the saved index. The bounds of their first characters reach the scan of the array, which
    is sorted by them."""
    sa = files.load_index(spark, f"{path}.index", ("sa",))["sa"]
    patterns = search.upper_patterns(patterns)
    heads = patterns.agg(F.min(F.substring("pattern", 1, 32)).alias("low"), F.max(F.substring("pattern", 1, 32)).alias("high"), F.max(F.length("pattern")).alias("longest")).first()
    if (heads["longest"] or 0) <= 32:
        sa = sa.where((F.col("p") >= (heads["low"] or "")) & (F.col("p") < (heads["high"] or "") + "~"))
    return search.matches(patterns, sa)


def shown(spark: SparkSession, path: str, hits: DataFrame, size: int) -> DataFrame:
    """k, place (1st, 2nd, ...), pos and found: the text at each of a few positions, from the saved blocks."""
    blocks = files.load_index(spark, f"{path}.index", ("blocks",))["blocks"]
    width = suffixes.CHUNK
    wanted = hits.select("k", "pos", F.explode(F.sequence(F.expr(f"pos div {width}"), F.expr(f"(pos + {max(size, 1)} - 1) div {width}"))).alias("block"))
    parts = wanted.join(blocks, "block").groupBy("k", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("x"))
    text = F.substring(F.array_join(F.col("x.text"), ""), (F.col("pos") % width + 1).cast("int"), F.lit(size))
    return parts.select("k", ordinal(F.col("k")).alias("place"), "pos", text.alias("found"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sufloom", description=__doc__.splitlines()[0])
    parser.add_argument("-v", "--version", action="version", version=f"sufloom {VERSION}")
    commands = parser.add_subparsers(dest="command", required=True)
    sort = commands.add_parser("suffix_sort")
    sort.add_argument("-k", "--kordered", type=int, default=256)
    sort.add_argument("-s", "--sorting-algorithm", default="PARALLEL_SORTING", type=str.upper, choices=["PARALLEL_SORTING", "PREFIX_DOUBLING"])
    build = commands.add_parser("fmindex_build")
    build.add_argument("-k", "--kordered", type=int, default=256, help="accepted; an index is always ordered by whole suffixes")
    build.add_argument("--strict", action="store_true", help="text of other characters than nucleotides is an error")
    ask = commands.add_parser("fmindex_query")
    ask.add_argument("-q", "--query")
    ask.add_argument("-n", "--headn", type=int, default=10)
    ask.add_argument("-b", "--batch")
    for c in (sort, build, ask):
        c.add_argument("file")
        c.add_argument("-g", "--generic", action="store_true", help="other alphabets: an error for commands; see suffixes.arrays")
        c.add_argument("--verbose", action="store_true")
        c.add_argument("-t", "--num_threads", default="*", help="cores of a local session; ignored where a cluster is configured")
    args = parser.parse_args(argv)
    if args.generic:
        parser.error("texts of other alphabets are not supported by the commands")
    if args.verbose:
        logging.basicConfig(level=logging.DEBUG)
    builder = SparkSession.builder.appName(f"sufloom-{args.command}")
    spark = SparkSession.getActiveSession() or builder.config("spark.master", f"local[{args.num_threads}]").getOrCreate()
    began = time.time()
    if args.command == "suffix_sort":
        suffix_sort(spark, args.file, args.kordered, args.sorting_algorithm).write.format("noop").mode("overwrite").save()
        print(f"sorted in {time.time() - began:.3f} s")
    elif args.command == "fmindex_build":
        print(fmindex_build(spark, args.file, args.strict))
    else:
        if args.query:
            one = spark.range(1).select(F.lit(0).alias("pattern_id"), F.lit(args.query.upper()).alias("pattern"))
            hits = located(spark, args.file, one)
            print(f"{hits.count()} occurrences")
            top = hits.orderBy("pos").limit(args.headn).withColumn("k", F.row_number().over(Window.orderBy("pos")))
            for r in shown(spark, args.file, top, len(args.query)).orderBy("k").collect():  # headn rows
                print(r["place"], r["pos"], r["found"])
        if args.batch:
            r = located(spark, args.file, files.read_patterns(spark, args.batch)).agg(F.count("*").alias("n"), F.sum("pos").alias("s")).first()
            print(f"{r['n']} occurrences, sum of positions {r['s'] or 0}, {time.time() - began:.3f} s")


if __name__ == "__main__":
    main()
