"""op2: a verdict on all pages.

The block list of the query are the hosts of which more than a quarter of the pages, and at least one, carry a tracking
parameter (utm_source) in their url.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .url_filter import filter_urls, host_of

_TRACKED = r"[?&]utm_source="


def listed_hosts(hosts: DataFrame) -> DataFrame:
    return hosts.where(F.col("tracked") * 4 > F.col("n")).select("host")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    hosts = stored(
        pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("url").rlike(_TRACKED), F.lit(False))).alias("tracked")),
        "hosts",
    )
    return filter_urls(pages, hosts.select("host"), listed_hosts(hosts)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op2_url_cascade": urls}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op2_url_cascade": rf"""
WITH p AS (
  SELECT page_id, url, coalesce({_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hosts AS (SELECT host FROM p GROUP BY host HAVING 4 * count(*) FILTER (regexp_matches(coalesce(url, ''), '[?&]utm_source=')) > count(*)),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN host IN (SELECT host FROM hosts) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
}
