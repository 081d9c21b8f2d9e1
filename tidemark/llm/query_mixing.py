"""op7: the mix of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import mix


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs, carry=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_mixing": mixing}
SQL = {
    "op7_mixing": r"""
WITH sized AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, '')) AS id, coalesce(source, '') AS src, source IS NULL AS none,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY none, src ORDER BY size, substr(md5(id), 1, 3), id) AS k FROM sized),
sources AS (SELECT src, none, CAST(sum(size) AS HUGEINT) AS s FROM sized GROUP BY src, none),
ranked AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY none, src) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS HUGEINT) AS w FROM sources),
filling AS (
  SELECT *, sum(s) OVER () AS total, sum(w) OVER (ORDER BY s * (6 // w), none, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
         2 * coalesce(sum(s) OVER (ORDER BY s * (6 // w), none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ranked),
limited AS (SELECT *, w * (3 * total - 2 * used) > 4 * s * left_w AS full_up FROM filling),
targets AS (
  SELECT src, none, s, full_up, CASE WHEN full_up THEN CAST(2 * s AS DOUBLE) ELSE
         CAST(w * (1500 * total - 1000 * coalesce(sum(CASE WHEN full_up THEN 2 * s END) OVER (), 0)) AS DOUBLE)
         / CAST(1000 * coalesce(sum(CASE WHEN NOT full_up THEN w END) OVER (), 1) AS DOUBLE) END AS target FROM limited),
mixed AS (
  SELECT n.*, t.s, t.target, t.full_up, CASE WHEN t.s > 0 THEN t.target / CAST(t.s AS DOUBLE) ELSE 0 END AS r,
         (CAST('0x' || substr(md5('mix' || n.src), 1, 4) AS INTEGER) + 0.5::DOUBLE) / 65536.0::DOUBLE AS u
  FROM numbered n JOIN targets t ON n.src = t.src AND n.none = t.none)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
       CAST(CASE WHEN full_up THEN CASE WHEN s > 0 THEN 2 ELSE 0 END
            ELSE least(floor(r * CAST(k AS DOUBLE) + u) - floor(r * CAST(k - 1 AS DOUBLE) + u), 2) END AS BIGINT) * size AS taken
FROM mixed"""
}
