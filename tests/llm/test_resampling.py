"""Importance resampling: the table of n-grams against plain counting, and the draw against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import crf, grams
from tidemark.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=2):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def texts(n, seed):
    rng = random.Random(seed)
    some = ["a", "The", "été", "龘", "x9", "Zebra-crossing", "w" * 31, "v" * 32, "u" * 33, "t" * 400, "s" * 70, "-", "\n", "B"]
    return [None, "", " - ", *(" ".join(rng.choices(some, k=rng.randint(0, 60))) for _ in range(n))]


def spans_of(all_texts, longest=2):
    data, cuts = crf.texts_of(pa.array([t.encode() if t is not None else None for t in all_texts], pa.binary()))
    return grams.Spans(data, cuts, longest)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_spans_and_keys(longest):
    all_texts = texts(60, 3)
    spans = spans_of(all_texts, longest)
    got = [bytes(spans.bytes[a : a + n]).decode() for a, n in zip(spans.starts.tolist(), spans.lengths.tolist(), strict=True)]
    want = [(k, f) for k, t in enumerate(all_texts) for f in features(t, longest)[1]]
    assert sorted(zip(spans.text.tolist(), got, strict=True)) == sorted(want)
    assert spans.words.tolist() == [len(features(t)[0]) for t in all_texts]
    assert grams.hashes(spans.bytes, spans.starts, spans.lengths).tolist() == [xxhash.xxh64_intdigest(g.encode()) for g in got]


@pytest.mark.parametrize("keys", [None, "one", "few"])
def test_table_counts_by_bytes(keys):
    """Equal keys of unlike n-grams don't join them."""
    spans = spans_of(texts(80, 5))
    given = None if keys is None else np.full(len(spans), 12, np.uint64) if keys == "one" else (spans.lengths % 3).astype(np.uint64)
    table = grams.GramTable(spans, 97, given)
    got = [bytes(spans.bytes[a : a + n]) for a, n in zip(spans.starts.tolist(), spans.lengths.tolist(), strict=True)]
    want = Counter(got)
    names = [got[i] for i in table.first.tolist()]
    assert dict(zip(names, table.count.tolist(), strict=True)) == want and len(names) == len(want)
    assert [names[k] for k in table.slot.tolist()] == got
    assert table.bucket.tolist() == [zlib.crc32(g) % 97 for g in names]


def plain(rows, target, percent=25, least=20, buckets=rs.BUCKETS):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x in rows for g in features(x)[1]), Counter(bucket(g) for x in target for g in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, x in rows:
        words, own = features(x)
        weight = sum(gain(bucket(g)) for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))[: percent * sum(r[1] >= least for r in out) // 100]
    return out, able


def test_draw_against_plain(spark):
    all_texts = texts(150, 9)
    rows = [(k * 3 % 151 if k else None, t) for k, t in enumerate(all_texts)]
    target = ["The zebra-crossing x9 B", None, "été 龘 B B"]
    docs = spark.createDataFrame([(i, t, "n", i) for i, t in rows], "doc_id bigint, text string, `rank` string, `a.b``c` bigint").repartition(5)
    found = rs.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), carry=("doc_id", "text", "rank", "a.b`c"))
    assert found.columns == ["doc_id", "text", "a.b`c", "n_features", "weight", "score", "rank"]
    got = found.collect()
    want, drawn = plain(rows, target)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got], key=key) == sorted([(i, n, w, s) for i, _, n, w, s in want], key=key)
    assert [(r["rank"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(k + 1, r[4]) for k, r in enumerate(drawn)]


def test_edges(spark):
    schema = "doc_id bigint, text string"
    none = spark.createDataFrame([], schema)
    assert rs.resample(none, none.select("text")).count() == 0
    same = spark.createDataFrame([(5, "one two three " * 10)] * 8 + [(None, None)] * 3 + [(1, "word " * 50_000)], schema)
    got = rs.resample(same, none.select("text"), percent=50).collect()
    assert len(got) == 12 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    assert {r["n_features"] for r in got if r["doc_id"] == 1} == {99_999} and {r["weight"] for r in got if r["doc_id"] is None} == {0}
