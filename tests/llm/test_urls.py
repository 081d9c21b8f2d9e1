import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import url_filter as u


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.randoms())
def test_cascade_is_exact_over_its_universe(keys, rng):
    keys = np.array(sorted(keys), np.uint64)
    listed = np.array([rng.random() < 0.3 for _ in keys], bool)
    levels = u.build_cascade(keys[listed], keys[~listed])
    assert (u.judge(levels, keys) == listed).all()


def test_cascade_of_many_keys_is_small():
    keys = np.random.default_rng(1).integers(0, 2**63, 200_000).astype(np.uint64)
    keys = np.unique(keys)
    levels = u.build_cascade(keys[:5000], keys[5000:])
    assert (u.judge(levels, keys) == (np.arange(len(keys)) < 5000)).all()
    assert sum(len(x.data) for x in levels) < 5000 * 2


URLS = [
    ("http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/EN/x", "example.net", "/EN/x", "net/", "block"),
    ("https://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
    ("https://x.net", "x.net", "", None, "allow"),
    ("https://x.net?a=/b", "x.net", "", None, "allow"),
    ("ftp://sub.example.com/de/1#z", "sub.example.com", "/de/1", "example.com/de/", "block"),
    ("//x.org/fr/", "", "", None, "allow"),
    ("a://b.org/fr/://c.net/", "b.org", "/fr/://c.net/", "org/fr/", "allow"),
    ("http://bad.io/", "bad.io", "/", None, "block"),
    ("http://bad.io/", "bad.io", "/", None, "block"),
    ("http://É.io/", "É.io", "/", None, "allow"),
    ("http://", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


@pytest.mark.parametrize(("limit", "shard_keys"), [(1 << 20, 100), (0, 2), (1 << 20, 1)])
def test_verdicts(spark, limit, shard_keys):
    pages = spark.createDataFrame([(i, row[0]) for i, row in enumerate(URLS)], "page_id long, url string").selectExpr("*", "'mine' AS _shard", "7 AS listed", "8 AS _key", "9 AS _rule", "10 AS Verdict")
    hosts = pages.select(u.host_of(pages.url).alias("host"))
    listed = spark.createDataFrame([("bad.io",), ("example.net",), ("elsewhere",)], "host string")
    got = u.filter_urls(pages, hosts, listed, limit=limit, shard_keys=shard_keys, part_rows=3).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(i, *row[1:]) for i, row in enumerate(URLS)]
    assert {r.page_id for r in got if r.listed} == {1, 8, 9}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "host string")
    assert u.filter_urls(pages, none, none).count() == 0
