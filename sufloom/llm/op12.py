"""op12: repair of damaged conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sufloom.llm.conversation_repair import damaged, repair_summaries

NAME = "op12_conversation_repair"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_summaries(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_FAR = 1_000_000_000  # the cost of a state that can't be reached


def _state(cost: str, audit: str, text: str) -> str:
    return f"{{'c': {cost}, 'a': {audit}, 't': {text}}}"


def _least(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


def _insert(s: str, role: str) -> str:
    return _state(f"{s}.c + 3", f"{s}.a || 'I'", f"list_append({s}.t, '{role}:')")


def _sql() -> str:
    """Dynamic programming over rows: for each state the least (cost, audit), with the lines that it leaves."""

    def stay(s: str, edit: str, cost: int, role: str, only: str) -> str:
        return _state(f"CASE WHEN must_go OR NOT ({only}) THEN {_FAR} ELSE {s}.c + {cost} + CASE WHEN fault = 't' THEN 3 ELSE 0 END END", f"{s}.a || '{edit}'", f"list_append({s}.t, {role} || ':' || text)")

    def gone(s: str) -> str:
        return _state(f"{s}.c + 4", f"{s}.a || 'D'", f"{s}.t")

    def kept(s: str, initial: str) -> str:
        return stay(s, "K", 0, "role", f"starts_with(role, '{initial}')")

    def other(s: str, role: str) -> str:
        return stay(s, "R", 3, f"'{role}'", "true")

    one = gone("s0"), _least(gone("s1"), kept("s0", "s"))
    two = _least(gone("s2"), *(f(s, x) for s in ("s0", "s1", "s3") for f, x in ((kept, "u"), (other, "user"))))
    three = _least(gone("s3"), kept("s2", "a"), other("s2", "assistant"))
    start = _state("CAST(0 AS BIGINT)", "''", "CAST([] AS VARCHAR[])")
    far = _state(f"CAST({_FAR} AS BIGINT)", "''", "CAST([] AS VARCHAR[])")
    with_two = _least("n2", *(_insert(s, "user") for s in ("n0", "n1", "n3")))
    crc = (
        "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda crc, b: "
        "list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v // 2, 3988292384 * (v % 2)))), 4294967295)"
    )
    blank = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
    return rf"""
WITH RECURSIVE
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
drawn AS (SELECT *, {crc} % 20 AS draw FROM keyed),
changed AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN draw = 0 THEN 0 WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM changed),
marked AS (
  SELECT *, CASE WHEN {blank} THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair
  FROM placed),
ids AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {start} AS s0, {far} AS s1, {_insert(start, "user")} AS s2, {_insert(_insert(start, "user"), "assistant")} AS s3 FROM ids
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, {_least("n3", _insert("m2", "assistant"))}
  FROM (SELECT conv_id, i, n0, n1, {with_two} AS m2, n3
        FROM (SELECT p.conv_id, r.i, {one[0]} AS n0, {one[1]} AS n1, {two} AS n2, {three} AS n3
              FROM paths p JOIN (SELECT *, fault IN ('b', 'd') AS must_go FROM marked) r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1))),
ends AS (
  SELECT p.conv_id, {_least("s0", "s3")} AS best
  FROM paths p LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(c.n, 0))
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit,
       sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE_SQL = _sql()
