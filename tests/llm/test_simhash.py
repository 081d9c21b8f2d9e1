import random

import numpy as np
import pytest
import xxhash

from tidemark.operators.components import components
from tidemark.llm.simhash import Forest, fingerprint, fingerprints, hexed, near_classes


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_classes(rows):
    """{row number: least id reachable}"""
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return prints, [least.get(find(i)) for i in range(len(rows))]


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "Éta", "δ", "42", "re,al"]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(n)]
    near = [b + " " + rng.choice(words) for b in base[: n // 3]]
    long = ["x y z " * 4000, "x y z " * 4000 + "w"]
    texts = [*base, *near, *base[:3], *long, None, "", " \t\n", "one", "one two"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, base[0]), (0, base[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_operator_against_all_pairs(spark, seed):
    rows = rows_of(seed, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS root", "3 AS component_id")
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in near_classes(fingerprints(docs)).select("doc_id", hexed("fp").alias("fingerprint"), "component_id").collect())
    prints, classes = brute_classes(rows)
    assert got == sorted((i is None, i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, classes, strict=True))


@pytest.mark.parametrize("most", [1, 20])
def test_large_shards_are_dealt_by_finer_cuts(spark, most):
    """Variants of one fingerprint, whose shards are all large: the classes of all pairs."""
    rng = random.Random(most)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 5, 7]))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(30)}
    values = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fp long")
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_classes(frame, most=most).collect()}
    assert got == {i: find(i) for i in range(len(values))}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_classes(fingerprints(docs)).count() == 0


def test_fingerprint_of_few_words():
    assert fingerprint(None) == fingerprint(b"") == 0
    assert fingerprint(b"One") == xxhash.xxh64_intdigest(b"one", 42)


def test_forest_finds_every_pair():
    rng = np.random.default_rng(5)
    shards = np.repeat(np.arange(6), [1, 2, 50, 200, 3, 100])
    values = rng.integers(0, 2**12, len(shards)).astype(np.uint64) * np.uint64(0x1000)
    keep = np.unique(np.stack([shards.astype(np.uint64), values]), axis=1)
    shards, values = keep[0].astype(np.int64), keep[1]
    got = {(int(a), int(b)) for i, j in Forest(shards, values).near(3) for a, b in zip(i, j, strict=True)}
    want = {(i, j) for i in range(len(values)) for j in range(i) if shards[i] == shards[j] and int(values[i] ^ values[j]).bit_count() <= 3}
    assert got == want


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{k: 100 for k in range(100, 160)}}
