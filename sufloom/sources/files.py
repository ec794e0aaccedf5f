"""Sequence files as DataFrames.

Record readers split files at record marks with Spark's line separator, so a large file is read by many tasks.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sufloom.sources.fastq import read_fastq  # noqa: F401
from sufloom.sources.scratch import partitions_of


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (up to the first space or tab) and seq (all lines joined) of each record."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value"))
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    body = F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1)
    return rows.where(F.length("value") > 0).select(F.regexp_extract(head, r"^([^ \t\r]*)", 1).alias("name"), F.regexp_replace(body, "[\r\n]", "").alias("seq"))


def write_fasta(records: DataFrame, path: str, **options) -> None:
    records.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.options(**options).text(path)


def write_fastq(records: DataFrame, path: str, **options) -> None:
    records.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.options(**options).text(path)


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """seq of each line of sequence of a FASTA file (headers left out), or of a plain text file, by the file's first
    character, with file, block and line, by which the lines are in order. A long record is many rows."""
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "\r$", "").alias("seq"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()  # one line
    if first and first[0]["value"].lstrip().startswith(">"):
        return lines.where(~F.ltrim("seq").startswith(">"))
    return lines


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern_id and pattern of a binary batch: two little-endian 32-bit numbers (length, count), then the
    patterns, whose acgt are read in upper case."""

    def little(at: int) -> Column:
        digits = F.concat(*(F.hex(F.substring("content", at + i, 1)) for i in (3, 2, 1, 0)))
        return F.conv(digits, 16, 10).cast("long")

    rows = spark.read.format("binaryFile").load(path).select("content", little(1).alias("size"), little(5).alias("number"))
    each = rows.where("number > 0 and size > 0").select("content", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("number") - 1)).alias("pattern_id"))
    start = (F.lit(9) + F.col("pattern_id") * F.col("size")).cast("int")
    return each.select("pattern_id", F.translate(F.decode(F.substring(F.col("content"), start, F.col("size").cast("int")), "UTF-8"), "acgt", "ACGT").alias("pattern"))


def write_records(rows: DataFrame, path: str) -> None:
    """Any flat rows as tab-separated fields."""
    rows.write.option("sep", "\t").csv(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def split_header(lines: DataFrame, symbols: tuple[str, ...] = ("#", "@")) -> tuple[DataFrame, DataFrame]:
    """Header lines (those that begin with a symbol) and the other lines of (value)."""
    marked = F.lit(False)
    for s in symbols:
        marked = marked | F.col("value").startswith(s)
    return lines.where(marked), lines.where(~marked)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality of tables as bags of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


INDEX_TABLES = ("sa", "c_table", "sampled", "bitmap", "lookup", "transform", "primary")
MANIFEST = "manifest"
BUCKETED = {"transform": ("seq_id", "b")}  # joined at each step of a search
KNOBS = {"k": 32, "interval": 4, "width": 64, "length": 4}


def write_bucketed(df: DataFrame, path: str, columns: tuple[str, ...], buckets: int) -> None:
    """Parquet at path, one file a bucket of the columns' hash."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).sortBy(*columns).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # its files stay


def read_bucketed(spark: SparkSession, path: str, columns: tuple[str, ...], buckets: int) -> DataFrame:
    """What write_bucketed wrote, so known to Spark that a join on the columns doesn't shuffle it."""
    name, own = f"bucketed_{uuid.uuid4().hex}", ", ".join(columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({own}) SORTED BY ({own}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def table_digest(df: DataFrame) -> tuple[int, int]:
    """Rows, and a checksum of all columns that doesn't depend on their order."""
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("x")).first()
    return row["n"], row["x"] or 0


def save_index(tables: dict[str, DataFrame], path: str, **knobs) -> str:
    """One Parquet folder a table in a new version folder, the array sorted by range partitions of its prefixes, so that a
    search for one prefix reads the files and row groups that can hold it alone, and the transform in buckets of its blocks,
    so that steps of a search shuffle no part of it. A line of the manifest with the knobs
    (order: the number of characters that the array is ordered by, None all; k, interval, width, length) and each table's
    digest, written last, makes the version the index: a build that fails before leaves the one there was. Returns the
    version."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = []
    for name, df in tables.items():
        if name == "sa":
            parts = partitions_of(df) if hasattr(df, "scratch_path") else max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
            df = df.repartitionByRange(parts, "p", "seq_id", "r").sortWithinPartitions("p", "seq_id", "r")
        if name in BUCKETED:
            write_bucketed(df, f"{path}/{version}/{name}", BUCKETED[name], buckets)
        else:
            df.write.parquet(f"{path}/{version}/{name}")
        lines.append((name, *table_digest(spark.read.parquet(f"{path}/{version}/{name}"))))
    order = knobs.pop("order", 32)
    rows = [(version, time.time_ns(), -1 if order is None else order, *(knobs.get(c, d) for c, d in KNOBS.items()), buckets if name in BUCKETED else None, name, n, x) for name, n, x in lines]
    schema = f"version string, written long, depth int, {', '.join(f'{c} int' for c in KNOBS)}, buckets int, name string, n long, digest long"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return version


def index_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows of the newest version, one a table."""
    lines = spark.read.parquet(f"{path}/{MANIFEST}")
    newest = lines.agg(F.max(F.struct("written", "version")).alias("x")).first()["x"]
    return lines.where(F.col("version") == newest["version"])


def load_index(spark: SparkSession, path: str, names: tuple[str, ...] = INDEX_TABLES, order: int | None = 0, check: bool = False) -> dict[str, DataFrame]:
    """Tables of the newest version. order: the depth that the caller needs (None: whole suffixes, as steps through the
    transform do; 0: any); an array of less is an error. check compares the tables with the manifest's digests."""
    lines = {r["name"]: r for r in index_manifest(spark, path).collect()}  # one row a table
    version, depth = next((r["version"], r["depth"]) for r in lines.values())
    if order != 0 and depth != -1 and (order is None or depth < order):
        raise ValueError(f"the index at {path} is ordered by {depth} characters, which is too few for this search")
    folder = f"{path}/{version}"
    tables = {n: read_bucketed(spark, f"{folder}/{n}", BUCKETED[n], lines[n]["buckets"]) if n in BUCKETED and lines[n]["buckets"] else spark.read.parquet(f"{folder}/{n}") for n in names}
    for name, df in tables.items():
        if check and table_digest(df) != (lines[name]["n"], lines[name]["digest"]):
            raise ValueError(f"table {name} of the index at {path} isn't what its manifest says")
    return tables


def same_index(spark: SparkSession, a: str, b: str) -> bool:
    """Equality of two saved indexes by knobs and digests."""
    own = ["depth", *KNOBS, "name", "n", "digest"]
    return sorted(map(tuple, index_manifest(spark, a).select(*own).collect())) == sorted(map(tuple, index_manifest(spark, b).select(*own).collect()))


def join_fields(array: Column) -> Column:
    """A list as one field: its items, separated by tabs."""
    return F.concat_ws("\t", array)


def split_fields(field: Column) -> Column:
    """The list that join_fields wrote; an empty field is an empty list."""
    return F.when(field == "", F.array().cast("array<string>")).otherwise(F.split(field, "\t", -1))
