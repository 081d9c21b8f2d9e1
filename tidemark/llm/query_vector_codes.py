"""op13: codes of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, codes


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")).drop("label")


def _sql() -> str:
    """All rounds one after the other, a component a row: distances of all parts to all entries, the nearest, the averages."""
    text = f"""
WITH good AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, embedding, label FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
x AS MATERIALIZED (
  SELECT r, i // (n // {PARTS}) AS p, i % (n // {PARTS}) AS k, CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT r, len(embedding) AS n, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM good)),
book0 AS MATERIALIZED (SELECT p, r AS e, k, v FROM x WHERE r < {ENTRIES})"""
    near = lambda k: f"""
near{k} AS MATERIALIZED (
  SELECT r, p, min(d * {ENTRIES} + e) AS best FROM (
    SELECT x.r, x.p, b.e, CAST(sum((x.v - b.v) * (x.v - b.v)) AS BIGINT) AS d FROM x JOIN book{k} b ON x.p = b.p AND x.k = b.k GROUP BY x.r, x.p, b.e) GROUP BY r, p)"""  # noqa: E731
    for k in range(ROUNDS):
        text += f""",{near(k)},
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.k, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT x.p, n.best % {ENTRIES} AS e, x.k, CAST(floor(CAST(sum(x.v) AS DOUBLE) / count(*)) AS BIGINT) AS v
    FROM x JOIN near{k} n ON x.r = n.r AND x.p = n.p GROUP BY x.p, n.best % {ENTRIES}, x.k) m ON b.p = m.p AND b.e = m.e AND b.k = m.k)"""
    return (
        text
        + f""",{near(ROUNDS)},
coded AS (
  SELECT r, string_agg(lower(printf('%02x', CAST(best % {ENTRIES} AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r)
SELECT g.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY g.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, k)) FROM book{ROUNDS}) AS codebooks_sha256
FROM good g JOIN coded c ON g.r = c.r"""
    )


QUERIES = {"op13_vector_codes": vector_codes}
SQL = {"op13_vector_codes": _sql()}
