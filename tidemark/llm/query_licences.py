"""op3: licences of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .licence_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS
from .licences import scan


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "digest", "licence", F.concat_ws(",", "notices").alias("notices"))


QUERIES = {"op3_licence_scan": licences}


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    bare = rf"regexp_replace(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?m)^[^a-z0-9\n©]*(copyright|\(c\)|©)[^\n]*$', ' ', 'g')"
    words = rf"string_split(trim(regexp_replace({bare}, '[\x00-\x2F\x3A-\x60\x7B-\x7F©]+', ' ', 'g')), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: coalesce(spell[w], w)), ' ')"


SQL = {
    "op3_licence_scan": f"""
WITH s AS (SELECT MAP {{{", ".join(f"{_sql_text(a)}: {_sql_text(b)}" for a, b in SPELLINGS.items())}}} AS spell),
texts AS (SELECT DISTINCT sha256({_canonical("t")}) AS digest, licence FROM (VALUES {", ".join(f"({_sql_text(t)}, '{n}')" for n, t in TEXTS.items())}) v(t, licence), s
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{d}', '{n}')" for n, d in DIGESTS)}) k(digest, licence)),
lines AS (SELECT DISTINCT sha256({_canonical("t")}) AS digest, licence FROM (VALUES {", ".join(f"({_sql_text(t)}, '{n}')" for t, n in NOTICES.items())}) v(t, licence), s),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_canonical("text")}) AS digest FROM documents, s),
l AS (SELECT DISTINCT r, lines.licence FROM (SELECT r, sha256({_canonical("line")}) AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d), s WHERE length(line) >= 6) x JOIN lines USING (digest)),
n AS (SELECT r, string_agg(licence, ',' ORDER BY licence) AS notices FROM l GROUP BY r)
SELECT doc_id, digest, texts.licence, coalesce(notices, '') AS notices FROM d LEFT JOIN texts USING (digest) LEFT JOIN n USING (r)"""
}
