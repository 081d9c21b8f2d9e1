"""op11: documents drawn by how much their n-grams look like the benchmark's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, table
from .resampling import BUCKETS, LEAST_WORDS, PERCENT, SEED, resample


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


QUERIES = {"op11_importance_resampling": importance_resampling}
_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
#: One step of crc32 (the reflected polynomial, a fixed value) for the low bit of an entry of its table.
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SQL = {
    "op11_importance_resampling": rf"""
WITH RECURSIVE steps AS (
  SELECT range AS i, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, {_BIT}, k + 1 FROM steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT i, c FROM steps WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT {_WORDS} AS w FROM benchmark),
df AS MATERIALIZED (
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM d),
bf AS MATERIALIZED (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM b),
grams AS MATERIALIZED (SELECT g, hex(encode(g)) AS h, octet_length(encode(g)) AS n FROM (SELECT g FROM df UNION SELECT g FROM bf)),
crc AS (
  SELECT g, h, n, 0 AS k, 4294967295 AS c FROM grams
  UNION ALL
  SELECT s.g, s.h, s.n, s.k + 1, xor(s.c >> 8, t.c) FROM crc s JOIN crc_table t ON t.i = xor(s.c & 255, CAST('0x' || substr(s.h, 2 * s.k + 1, 2) AS BIGINT)) WHERE s.k < s.n),
hashed AS MATERIALIZED (SELECT g, xor(c, 4294967295) % {BUCKETS} AS bucket FROM crc WHERE k = n),
s AS (SELECT bucket, count(*) AS n FROM df JOIN hashed USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN hashed USING (g) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM df) AS s, (SELECT count(*) FROM bf) AS t),
gains AS MATERIALIZED (
  SELECT s.bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + {BUCKETS})::DOUBLE) / ((s.n + 1)::DOUBLE * (totals.t + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT r, count(*) AS n, sum(gain) AS total FROM df JOIN hashed USING (g) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT d.r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
         CAST(CASE WHEN n > 0 THEN CASE WHEN total % n < 0 THEN total // n - 1 ELSE total // n END ELSE 0 END AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN weights USING (r)),
final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
places AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS n FROM final WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN k <= {PERCENT} * n // 100 THEN k END AS rank
FROM final LEFT JOIN places USING (r)"""
}
