"""The story store: three batches are one, a batch run again changes nothing, and classes are those of plain union-find."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import titles
from tidemark.operators import story_store

BASE = "The central bank of the far north raises its rates by a quarter again"


def items(n, seed):
    rng, out = random.Random(seed), []
    heads = [BASE[:k] for k in (10, 14, 20, 24, 31, 40, 55)] + [f"Another matter entirely number {k} of the day" for k in range(12)] + ["", "!!!", "  ", "Fed cuts", "FED  CUTS!", None]
    for k in range(n):
        head = rng.choice(heads)
        if head and rng.random() < 0.3:
            head += rng.choice([" and more", " - wire", "...", "…", " ok"])
        url = rng.choice(["https://e.com/a", "https://e.com/a?utm_source=x", "http://e.com/b#f", None, "", *(f"https://n.org/{rng.randint(0, 60)}" for _ in range(6))])
        seen = dt.datetime(2026, 5, 1) + dt.timedelta(hours=k)
        published = rng.choice([None, seen - dt.timedelta(hours=rng.randint(1, 30)), seen + dt.timedelta(days=2)])
        source = rng.choice(["Bing", "Truth Social @a"])
        out.append((k + 1, head, rng.choice([None, "", "RT @a", "short text", "a longer text of it"]), source, url, f"p{k % 3}", rng.choice(["low", "medium", "high", None]), rng.random() < 0.2, rng.choice([None, "", "A,B"]), published, seen))
    return out


def shown(spark, store):
    return sorted(map(tuple, story_store.stories(spark, store).collect()))


def classes(rows):
    """Least item of each class, and its members, from (item_id, key, url_key, plain)."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((root(a), root(b)), key=str)
        parent[b] = a

    for r in rows:
        for key in (r["key"], r["url_key"]):
            join(f"{r['event_id']:020d}", key)
    plains = {r["plain"]: r["key"] for r in rows if r["plain"]}
    for a in plains:
        for b in plains:
            if a != b and a.startswith(b):
                join(plains[a], plains[b])
    found = {}
    for r in rows:
        found.setdefault(root(f"{r['event_id']:020d}"), []).append(r["event_id"])
    return {min(members): sorted(members) for members in found.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_and_replays(spark, tmp_path, seed):
    df = spark.createDataFrame(items(120, seed), story_store.OBSERVED)
    whole, parts = f"{tmp_path}/whole", f"{tmp_path}/parts"
    story_store.upsert(df, whole, 0)
    want = shown(spark, whole)
    cuts = [df.where("item_id <= 30"), df.where("item_id > 30 AND item_id <= 80"), df.where("item_id > 80")]
    for k, part in enumerate(cuts):
        story_store.upsert(part, parts, k)
    assert shown(spark, parts) == want
    # The last batch, and then all, once more.
    story_store.upsert(cuts[2], parts, 2)
    assert shown(spark, parts) == want
    for k, part in enumerate(cuts):
        story_store.upsert(part, parts, k)
    assert shown(spark, parts) == want
    # Other orders and cuts give the same stories.
    other = f"{tmp_path}/other"
    for k, part in enumerate([df.where("item_id % 3 = 1"), df.where("item_id % 3 = 0"), df.where("item_id % 3 = 2"), df.limit(0)]):
        story_store.upsert(part, other, k)
    assert shown(spark, other) == want
    found = classes(story_store.observed(df).collect())
    assert {r[0]: r[-1] for r in want} == {k: len(v) for k, v in found.items()}
    _, keys = story_store.state(spark, parts)
    assert {r["event_id"] for r in keys.collect()} == set(found)


def test_stream(spark, tmp_path):
    df = spark.createDataFrame(items(60, 7), story_store.OBSERVED)
    landing, store, whole = f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/whole"
    name = uuid.uuid4().hex
    df.where("item_id <= 20").coalesce(1).write.parquet(landing)
    story_store.run(spark, landing, store, name).awaitTermination()
    df.where("item_id > 20 AND item_id <= 40").coalesce(1).write.mode("append").parquet(landing)
    df.where("item_id > 40").coalesce(1).write.mode("append").parquet(landing)
    story_store.run(spark, landing, store, name).awaitTermination()
    story_store.upsert(df, whole, 0)
    assert shown(spark, store) == shown(spark, whole)


def test_columns_of_a_story(spark, tmp_path):
    at = lambda h: dt.datetime(2026, 5, 1, h)
    rows = [
        (5, "Fed  raises rates by a quarter point", "", "Bing", "https://e.com/a?utm_source=x", "p", "low", False, None, None, at(5)),
        (3, "Fed raises rates by a quarter point - after long talks", "why it did so", "Truth Social @a", "https://e.com/z", "q", "medium", False, "A", at(9), at(3)),
        (8, "Something else", "more of the story here", "Bing", "https://e.com/a/", "r", "high", True, "B", at(1), at(8)),
        (9, "A long but empty placeholder whose url is the same as that of the story", "RT @x", "Truth Social @a", "https://e.com/a", "s", None, None, "C", at(2), at(9)),
        (11, "Fed cuts", None, None, "https://e.com/q", None, None, None, None, None, None),
    ]
    story_store.upsert(spark.createDataFrame(rows, story_store.OBSERVED), f"{tmp_path}/s", 0)
    first, other = sorted(story_store.stories(spark, f"{tmp_path}/s").collect())
    assert first.asDict() == {
        "event_id": 3, "title": "Fed raises rates by a quarter point - after long talks", "snippet": "more of the story here", "impact": "high", "has_market_kw": True, "tickers": "A", "url": "https://e.com/z",
        "canonical_url": "https://e.com/z", "source": "Truth Social @a", "kol_key": "q", "published_at": at(1), "published_status": "verified", "first_seen": at(3), "last_seen": at(9), "observations": 4,
    }
    assert (other["event_id"], other["impact"], other["published_status"], other["observations"]) == (11, "low", "unknown", 1)


def test_display_titles(spark):
    def plain(title):
        import re

        t = re.sub(r"\s+", " ", (title or "").strip())
        s = re.sub(r"(?:\s*(?:\.{3}|…))+\s*$", "", t)
        for size in range((len(s) + 1) // 2, len(s)):
            if len(s) - size >= 6 and s[:size].startswith(s[size:]):
                return s[:size].strip()
        return t

    rng = random.Random(4)
    given = [None, "", "  a \n b ", "same same", "The markets fallThe markets", "The markets fall The markets f...", "abcdefabcdef", "中国央行宣布降息中国央行宣布…", *("".join(rng.choices("ab ", k=rng.randint(1, 30))) for _ in range(300))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string")
    got = [r[1] for r in df.select("k", story_store.display_title(F.col("t"))).orderBy("k").collect()]
    assert got == [plain(t) for t in given]
    assert titles.LEAST == 16
