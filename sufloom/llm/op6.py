"""op6: verdicts on the URLs of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sufloom.llm.url_filter import judge, labelled_urls, sample_urls, train

NAME = "op6_url_filter"
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, train(sample_urls(spark)))
    return rows.select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH RECURSIVE labelled(id, url, y) AS (VALUES %s),
urls AS (
  SELECT 'label' AS kind, id, url, CAST(NULL AS BIGINT) AS page_id FROM labelled
  UNION ALL SELECT 'page', row_number() OVER (), url, page_id FROM pages),
rests AS (SELECT *, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM urls),
split AS MATERIALIZED (
  SELECT kind, id, page_id, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM rests),
marked AS (
  SELECT kind, id, part, text, unnest([3, 4]) AS n FROM (
    SELECT kind, id, 'h' AS part, '^' || host || '$' AS text FROM split WHERE host || path <> ''
    UNION ALL SELECT kind, id, 'p', '^' || path || '$' FROM split WHERE host || path <> '')),
places AS (SELECT *, unnest(range(1, greatest(length(text) - n + 1, 1) + 1)) AS i FROM marked),
features AS MATERIALIZED (
  SELECT DISTINCT kind, id, CAST('0x' || substring(md5(part || substring(text, i, n)), 1, 4) AS INTEGER) %% 4096 AS bucket FROM places
  UNION ALL SELECT kind, id, 4096 FROM split),
x AS MATERIALIZED (SELECT id, bucket, y FROM features JOIN labelled USING (id) WHERE kind = 'label'),
held AS MATERIALIZED (SELECT bucket, count(*) AS n, (SELECT count(*) / count(DISTINCT id) FROM x) AS mean FROM x GROUP BY bucket),
fit(epoch, bucket, w) AS (
  SELECT 0, bucket, CAST(0 AS DOUBLE) FROM held
  UNION ALL
  SELECT f.epoch + 1, f.bucket, f.w * (1 - 1e-3) + 8.0 / held.mean * t.total / (held.n + 4.0)
  FROM fit f JOIN held ON held.bucket = f.bucket JOIN (
    SELECT x.bucket, sum(g.gap) AS total FROM x JOIN (
      SELECT x.id, any_value(x.y) - 1 / (1 + exp(-sum(fit.w))) AS gap FROM x JOIN fit ON fit.bucket = x.bucket GROUP BY x.id) g ON g.id = x.id
    GROUP BY x.bucket) t ON t.bucket = f.bucket
  WHERE f.epoch < 60),
scored AS (
  SELECT id, 1 / (1 + exp(-sum(coalesce(w, 0)))) AS score FROM features
  LEFT JOIN (SELECT bucket, w FROM fit WHERE epoch = 60) USING (bucket) WHERE kind = 'page' GROUP BY id),
rules(host, path, verdict) AS (VALUES %s),
hits AS (
  SELECT s.id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  WHERE s.kind = 'page' GROUP BY s.id)
SELECT s.page_id, s.host, s.path, h.rule, coalesce(h.verdict, CASE WHEN m.score > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM split s JOIN scored m USING (id) LEFT JOIN hits h USING (id) WHERE s.kind = 'page'
""" % (
    ", ".join(f"({i}, '{url}', {y})" for i, (url, y) in enumerate(labelled_urls())),
    ", ".join(str(rule) for rule in RULES),
)
