"""op1: MinHash near-dedup of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sufloom.llm.near_dedup import near_duplicates

NAME = "op1_minhash_near_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, percent=80)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
                      WHEN len(w) = 1 THEN [w[1]]
                      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
coded AS (SELECT doc_id, n, hash(x) AS x FROM items),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM coded a JOIN coded b ON a.x = b.x AND a.doc_id <> b.doc_id AND b.n * 100 >= a.n * 80 AND a.n * 100 >= b.n * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id, sets.doc_id = c.component_id AS kept
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = sets.doc_id
"""
