"""Exact pattern search on suffix arrays.

patterns are rows (pattern_id, pattern). A suffix matches if it begins with the pattern: an equi-join on as many first
characters as a pattern has, for each length that occurs, so a suffix is never compared with every pattern; batches too
large to be broadcast are merged with the sorted array (merge.short_matches).
Patterns with other characters than A, C, G, T match nothing here. A pattern longer than the indexed prefix is cut into parts
of `indexed` characters, at 0, `indexed`, 2 * `indexed`, ... and at its end, all looked up in one pass over the array: it
matches where the array has all of them at their distances. So only rows that begin with a part are shuffled, and the array
is never a side of a join with matches; for that, p must hold `indexed` characters of each suffix, or all that it has. An empty pattern matches every suffix, the
empty one too. Lower case is the caller's to fold (upper_patterns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sufloom.operators import merge
from sufloom.operators.index import LETTERS
from sufloom.sources.scratch import discard, materialize

SMALL = 8 << 20  # bytes of patterns, by an estimate; up to so many are broadcast


def upper_patterns(patterns: DataFrame) -> DataFrame:
    """The patterns with acgt in upper case, as the index stores texts."""
    return patterns.withColumn("pattern", F.translate("pattern", "acgt", "ACGT"))


def matches(patterns: DataFrame, sa: DataFrame, indexed: int = 32) -> DataFrame:
    """pattern_id, pattern, seq_id, r, pos of every match, for patterns of any length."""
    longest = patterns.agg(F.max(F.length("pattern"))).first()[0] or 0
    if longest <= indexed:
        return _short(patterns, sa, indexed)
    # The parts of all long patterns are looked up in one pass over the array; a pattern is where all of its parts are.
    long = patterns.where(F.length("pattern") > indexed)
    own = materialize(long.select("pattern").distinct().withColumn("_q", F.monotonically_increasing_id()), "long")
    last = F.length("pattern") - indexed
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(indexed)), F.array(last)))
    parts = own.select("_q", "pattern", F.size(offsets).alias("_parts"), F.explode(offsets).alias("_at"))
    parts = parts.select("_q", "_parts", "_at", F.substring(F.col("pattern"), F.col("_at") + 1, F.lit(indexed)).alias("_part"))
    small = (parts.agg(F.sum(F.lit(indexed + 64))).first()[0] or 0) + (long.agg(F.sum(F.length("pattern") + 64)).first()[0] or 0) <= SMALL
    held = F.broadcast if small else lambda table: table
    keys = parts.select("_part").distinct()
    found = _short(keys.select(F.col("_part").alias("pattern_id"), F.col("_part").alias("pattern")), sa, indexed)
    found = found.select(F.col("pattern").alias("_part"), "seq_id", "r", "pos").join(held(parts), "_part")
    whole = found.groupBy("_q", "seq_id", (F.col("pos") - F.col("_at")).alias("pos")).agg(F.count("*").alias("_n"), F.first("_parts").alias("_parts"), F.max(F.when(F.col("_at") == 0, F.col("r"))).alias("r")).where("_n = _parts")
    hits = whole.join(held(own), "_q").join(held(long), "pattern").select("pattern_id", "pattern", "seq_id", "r", "pos")
    return _short(patterns.where(F.length("pattern") <= indexed), sa, indexed).unionByName(hits)


def _short(patterns: DataFrame, sa: DataFrame, indexed: int, by: str = "pattern") -> DataFrame:
    """matches() of the patterns' column `by`, of at most `indexed` characters."""
    own = patterns.select("pattern_id", "pattern", F.col(by).alias("key")).where(F.length("key") <= indexed)
    sizes = own.groupBy(F.length("key").alias("l")).agg(F.count("*").alias("n")).collect()  # at most `indexed` + 1 rows
    lengths = sorted(r["l"] for r in sizes)
    if not lengths:
        return own.where(F.lit(False)).select("pattern_id", "pattern", *(F.lit(None).cast("long").alias(c) for c in ("seq_id", "r", "pos")))
    keys = own.groupBy("key").agg(F.collect_list(F.struct("pattern_id", "pattern")).alias("asked"))
    rows = sa.select("seq_id", "r", "pos", "p")
    if sum(r["n"] * (r["l"] + 64) for r in sizes) <= SMALL:
        # One lookup for each length that occurs, in a broadcast table: no suffix is copied before it has matched.
        for l in lengths:
            table = keys.where(F.length("key") == l).select(F.col("key").alias(f"key_{l}"), F.col("asked").alias(f"asked_{l}"))
            rows = rows.join(F.broadcast(table), F.substring("p", 1, l) == F.col(f"key_{l}"), "left")
        met = F.concat(*(F.coalesce(f"asked_{l}", F.array().cast(keys.schema["asked"].dataType)) for l in lengths))
        some = F.lit(False)
        for l in lengths:
            some = some | F.col(f"asked_{l}").isNotNull()
        return rows.where(some).select("seq_id", "r", "pos", F.explode(met).alias("x")).select("x.pattern_id", "x.pattern", "seq_id", "r", "pos")
    return merge.short_matches(own, sa.select("seq_id", "r", "pos", "p"), "key", 0)


def count(patterns: DataFrame, sa: DataFrame, indexed: int = 32) -> DataFrame:
    """pattern_id, pattern, n, positions (their sum), of every pattern; 0 where nothing matches."""
    hits = matches(patterns, sa, indexed).groupBy("pattern_id").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))
    return patterns.join(hits, "pattern_id", "left").select("pattern_id", "pattern", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positions", F.lit(0)).alias("positions"))


def ranges(patterns: DataFrame, sa: DataFrame, indexed: int = 32) -> DataFrame:
    """pattern_id, seq_id, beg, end: the rows of each pattern's matches in each text with any. An array ordered by
    `indexed` characters has no such range for a longer pattern: an error."""
    if (patterns.agg(F.max(F.length("pattern"))).first()[0] or 0) > indexed:
        raise ValueError(f"the matches of patterns of more than {indexed} characters are no range of rows; see matches()")
    return matches(patterns, sa, indexed).groupBy("pattern_id", "seq_id").agg(F.min("r").alias("beg"), (F.max("r") + 1).alias("end"))


def with_match(patterns: DataFrame, sa: DataFrame, indexed: int = 32) -> DataFrame:
    return patterns.join(matches(patterns, sa, indexed).select("pattern_id").distinct(), "pattern_id", "left_semi")


def without_match(patterns: DataFrame, sa: DataFrame, indexed: int = 32) -> DataFrame:
    return patterns.join(matches(patterns, sa, indexed).select("pattern_id").distinct(), "pattern_id", "left_anti")


def first_positions(patterns: DataFrame, sa: DataFrame, texts: DataFrame, head: int = 10, indexed: int = 32) -> DataFrame:
    """pattern_id, place (1st, 2nd, ...), seq_id, pos, found (the text there) of each pattern's first matches."""
    from pyspark.sql import Window

    from sufloom.functions.codec import ordinal

    place = F.row_number().over(Window.partitionBy("pattern_id").orderBy("seq_id", "pos"))
    top = matches(patterns, sa, indexed).withColumn("k", place).where(F.col("k") <= head)
    shown = F.substring(F.col("text"), (F.col("pos") + 1).cast("int"), F.length("pattern"))
    return top.join(texts.select("seq_id", "text"), "seq_id").select("pattern_id", ordinal(F.col("k")).alias("place"), "seq_id", "pos", shown.alias("found"))


def verified(patterns: DataFrame, sa: DataFrame, texts: DataFrame, indexed: int = 32) -> DataFrame:
    """matches for patterns of any length: the first `indexed` characters by the index, the rest against the text."""
    keyed = patterns.withColumn("full", F.col("pattern")).withColumn("pattern", F.substring("pattern", 1, indexed))
    found = matches(keyed.select("pattern_id", "pattern"), sa, indexed).drop("pattern").join(keyed.select("pattern_id", "full"), "pattern_id")
    whole = found.where(F.length("full") <= indexed)
    long = found.where(F.length("full") > indexed).join(texts.select("seq_id", "text"), "seq_id")
    long = long.where(F.substring(F.col("text"), (F.col("pos") + 1).cast("int"), F.length("full")) == F.col("full")).drop("text")
    return whole.unionByName(long).select("pattern_id", F.col("full").alias("pattern"), "seq_id", "r", "pos")


def _rank(state: DataFrame, blocks: DataFrame, at: str, char: Column, out: str, width: int) -> DataFrame:
    """state with `out`: how often char stands in the transform before row `at`; blocks: index.transform_blocks."""
    own = blocks.select("seq_id", F.col("b").alias("_b"), F.col("bwt").alias("_bwt"), *(F.col(f"o_{c}").alias(f"_o_{c}") for c in LETTERS))
    head = F.substring(F.col("_bwt"), F.lit(1), (F.col(at) % width).cast("int"))
    before = F.coalesce(*(F.when(char == c, F.col(f"_o_{c}")) for c in LETTERS), F.lit(0))
    found = state.withColumn("_b", F.expr(f"{at} div {width}")).join(own, ["seq_id", "_b"], "left")
    return found.withColumn(out, before + F.length(head) - F.length(F.replace(head, char))).drop("_b", "_bwt", *(f"_o_{c}" for c in LETTERS))


def backward_search(patterns: DataFrame, counts: DataFrame, blocks: DataFrame, stop: int = 0, start: DataFrame | None = None, width: int = 64) -> DataFrame:
    """pattern_id, seq_id, beg, end, remaining: each pattern's range in each text, a character at a time from the right.

    Before each step a range of at most `stop` rows ends the search (an empty one always does); remaining is the number
    of characters left. An empty pattern, or an empty range to go on
    from, has nothing remaining. The array must be ordered by whole suffixes: on one ordered by k characters, suffixes that
    repeat k characters may change places in a step. start: (pattern_id, seq_id, beg, end), ranges to go on from,
    those of what follows the pattern; else all rows of each text. counts: index.c_table; blocks: index.transform_blocks,
    of `width` rows. The state is written to the shared folder every few steps.
    """
    longest = patterns.agg(F.max(F.length("pattern"))).first()[0] or 0
    totals = counts.select("seq_id", "n", *(f"c_{c}" for c in LETTERS))
    if start is None:  # every pattern in every text: dealt out by the pattern's last character
        each = totals.select("*", F.explode(F.array(*map(F.lit, ("", *LETTERS)))).alias("last"))
        tail = F.substring("pattern", -1, 1)
        asked = patterns.select("pattern_id", "pattern", F.when(tail.isin(*LETTERS), tail).otherwise("").alias("last"))
        state = each.join(asked, "last").withColumns({"beg": F.lit(0).cast("long"), "end": F.col("n")}).drop("last")
    else:
        state = start.select("pattern_id", "seq_id", "beg", "end").join(patterns.select("pattern_id", "pattern"), "pattern_id").join(totals, "seq_id")
    state = state.drop("n").withColumn("remaining", F.when(F.col("beg") < F.col("end"), F.length("pattern")).otherwise(0))
    written = None
    for step in range(longest):
        active = (F.col("remaining") > 0) & (F.col("end") - F.col("beg") >= stop + 1)
        c = F.substring(F.col("pattern"), F.col("remaining"), F.lit(1))
        base = F.coalesce(*(F.when(c == x, F.col(f"c_{x}")) for x in LETTERS), F.lit(0))
        moved = _rank(_rank(state.where(active), blocks, "beg", c, "low", width), blocks, "end", c, "high", width)
        moved = moved.withColumns({"beg": base + F.col("low"), "end": base + F.col("high"), "remaining": F.col("remaining") - 1}).drop("low", "high")
        state = state.where(~active).unionByName(moved)
        if step % 3 == 2:
            state, old = materialize(state, "backward"), written
            if old is not None:
                discard(old)
            written = state
    return state.select("pattern_id", "seq_id", "beg", "end", F.col("remaining").cast("int").alias("remaining"))


def located(ranges_: DataFrame, counts: DataFrame, blocks: DataFrame, sampled: DataFrame, interval: int = 4, width: int = 64) -> DataFrame:
    """pattern_id, seq_id, r, pos of every row of the ranges (pattern_id, seq_id, beg, end), from the sampled array alone, of
    an array ordered by whole suffixes: a row goes on to that of the position before it until it meets a sampled one, `interval` - 1 steps at most."""
    rows = ranges_.where("beg < end").select("pattern_id", "seq_id", F.explode(F.sequence(F.col("beg"), F.col("end") - 1)).alias("r"))
    state = rows.withColumn("at", F.col("r"))
    samples = sampled.select("seq_id", F.col("r").alias("at"), F.col("pos").alias("_pos"))
    out = None
    for steps in range(interval):
        joined = state.join(samples, ["seq_id", "at"], "left")
        done = joined.where("_pos is not null").select("pattern_id", "seq_id", "r", (F.col("_pos") + steps).alias("pos"))
        out = done if out is None else out.unionByName(done)
        if steps == interval - 1:
            return out
        open_ = joined.where("_pos is null").drop("_pos").withColumn("_b", F.expr(f"at div {width}"))
        letter = blocks.select("seq_id", F.col("b").alias("_b"), F.col("bwt").alias("_text"))
        open_ = open_.join(letter, ["seq_id", "_b"]).withColumn("_c", F.substring(F.col("_text"), (F.col("at") % width + 1).cast("int"), F.lit(1))).drop("_b", "_text")
        open_ = _rank(open_, blocks, "at", F.col("_c"), "_low", width).join(counts.select("seq_id", *(f"c_{c}" for c in LETTERS)), "seq_id")
        base = F.coalesce(*(F.when(F.col("_c") == x, F.col(f"c_{x}")) for x in LETTERS), F.lit(0))
        state = open_.select("pattern_id", "seq_id", "r", (base + F.col("_low")).alias("at"))
