"""Nucleotide codes as column expressions: A, C, G, T are 0 to 3, anything else is 4 (N).

Only ASCII letters change case; a byte of another script is N. All expressions give null for null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_dna(text: Column) -> Column:
    """The text as the index stores it: line breaks removed, acgt in upper case, everything else A (N folds to A)."""
    return F.regexp_replace(F.translate(text, "acgt\n", "ACGT"), "[^ACGT]", "A")


def is_valid(text: Column) -> Column:
    """Non-empty and of nucleotides alone."""
    return text.rlike("^[ACGTacgt]+$")


def validated(text: Column) -> Column:
    """The text as it is; an error at run time where a character is no upper-case nucleotide."""
    return F.when(text.rlike("[^ACGT]"), F.raise_error(F.lit("the text holds other characters than A, C, G, T")).cast("string")).otherwise(text)


def to_codes(text: Column) -> Column:
    """One digit for each character: 0 to 3, or 4."""
    return F.translate(F.regexp_replace(F.translate(text, "acgt", "ACGT"), "[^ACGT]", "N"), "ACGTN", "01234")


def to_chars(codes: Column) -> Column:
    return F.translate(codes, "01234", "ACGTN")


def sequence_key(text: Column) -> Column:
    """The two-bit number of at most 31 characters, the first the most significant; N counts as A. An empty text is 0."""
    return F.coalesce(F.conv(F.translate(to_codes(text), "4", "0"), 4, 10).cast("long"), F.when(text.isNotNull(), F.lit(0).cast("long")))


def sequence_of(key: Column, size: int | Column) -> Column:
    """The text of `size` characters whose sequence_key is key."""
    return F.translate(F.lpad(F.conv(key.cast("string"), 10, 4), F.lit(size) if isinstance(size, int) else size, F.lit("0")), "0123", "ACGT")


WINDOW = 31  # characters that a key holds


def windows(texts: DataFrame) -> DataFrame:
    """seq_id, w, s: the whole of each text as consecutive windows of at most WINDOW characters, cut from chunks as
    suffixes are. An empty text is one empty window."""
    size = 64 * WINDOW
    text = F.coalesce(F.col("text"), F.lit(""))
    starts = texts.select("seq_id", text.alias("text"), F.explode(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))).alias("start"))
    chunks = starts.select("seq_id", "start", F.substring(F.col("text"), F.col("start") + 1, F.lit(size)).alias("chunk"))
    each = chunks.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.length("chunk") - 1, F.lit(0)), F.lit(WINDOW))).alias("i"))
    return each.select("seq_id", F.expr(f"(start + i) div {WINDOW}").alias("w"), F.substring(F.col("chunk"), F.col("i") + 1, F.lit(WINDOW)).alias("s"))


def reverse_complement(text: Column) -> Column:
    """In upper case; what is no nucleotide becomes N."""
    return F.reverse(F.translate(to_chars(to_codes(text)), "ACGTN", "TGCAN"))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th; eleventh to nineteenth of each hundred take th."""
    last, teens = n % 10, (n % 100).between(10, 19)
    return F.concat(n.cast("string"), F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def prefix_key(text: Column, size: int) -> Column:
    """sequence_key of the first `size` characters, short texts padded with A."""
    return sequence_key(F.rpad(F.substring(text, 1, size), size, "A"))
