"""Vector codes against plain Python: rounds without bounds, ties, dropped vectors, labels of any share."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import vector_codes as vc


def plain(rows, parts=4, entries=256, rounds=4):
    """(code, error) by id, and the digest, each distance measured."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(1024 * c) for c in v] for _, v in kept]
    size = len(x[0]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in x]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((m - n) ** 2 for m, n in zip(a, b, strict=True))
    for k in range(rounds + 1):
        own = [[min((far(v[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for v in cut]
        if k == rounds:
            break
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [v[p] for v, o in zip(cut, own, strict=True) if o[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{o[1]:02x}" for o in found), sum(o[0] for o in found)) for (i, _), found in zip(kept, own, strict=True)], digest


def vectors(n, seed, steps=None, size=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)) * 0.2 + rng.integers(0, 3, (n, 1))
    return (np.round(x * steps) / steps if steps else x).tolist()


@pytest.mark.parametrize(("n", "entries", "steps"), [(300, 32, None), (400, 256, 4), (90, 256, None), (1500, 40, 2)])
def test_against_plain(spark, n, entries, steps):
    rows = [(i * 7 % n, v) for i, v in enumerate(vectors(n, n, steps))]
    docs = spark.createDataFrame([(i, v, i % 3) for i, v in rows], "vec_id bigint, embedding array<float>, label int").repartition(3)
    rows = [(r["vec_id"], list(r["embedding"])) for r in docs.collect()]
    found = {r["vec_id"]: r for r in vc.codes(docs, entries=entries).collect()}
    want, digest = plain(rows, entries=entries)
    assert len(found) == n
    for i, code, error in want:
        assert (found[i]["code"], found[i]["error"], found[i]["codebooks_sha256"]) == (code, error, digest)
        assert found[i]["label_error"] == sum(e for j, _, e in want if j % 3 == i % 3)


def test_bounds_spare_work_and_keep_results():
    """Passes with bounds give what measuring everything gives; parts that are far from a change need nothing."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (40, 4))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 4))).astype(np.int64)
    entries = x[:40].copy()
    state, spared = vc.Bounds.empty(len(x), 8), []
    for k in range(6):
        squares, need = state.assigned(x, entries)
        every = vc.measured(x, entries)
        assert (state.own == every.argmin(axis=1)).all() and (squares == every.min(axis=1)).all()
        spared.append((need == 0).mean())
        moved = np.stack([x[state.own == e].sum(axis=0) // max(1, (state.own == e).sum()) if (state.own == e).any() else entries[e] for e in range(40)])
        state.moved(np.sqrt(((moved - entries) ** 2).sum(axis=1)))
        # The bounds stay true.
        exact = np.sqrt(vc.measured(x, moved).astype(float))
        real = np.isfinite(state.low)
        assert (state.low <= np.take_along_axis(exact, state.tracked.astype(int), 1))[real].all()
        exact[np.arange(len(x)), state.own] = np.inf
        exact[np.repeat(np.arange(len(x)), real.sum(axis=1)), state.tracked[real]] = np.inf
        assert (exact.min(axis=1) >= state.outer).all()
        state = state.resized([8, 4, 16, 6, 6, 6][k])
        entries = moved
    assert spared[0] == 0 and spared[-1] > 0.5


def test_exact_beyond_floats():
    rng = np.random.default_rng(5)
    x, entries = rng.integers(-vc.MOST, vc.MOST, (50, 16)), rng.integers(-vc.MOST, vc.MOST, (9, 16))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)) for e in entries] for v in x]
    assert vc.measured(x, entries).tolist() == want


def test_width_follows_use():
    assert vc.next_width(8, np.array([10, 0, 0, 0, 0, 0, 0, 0, 0, 90])) == 16
    assert vc.next_width(64, np.array([0] * 65 + [9])) == vc.WIDEST
    assert vc.next_width(16, np.array([95] + [0] * 16 + [5])) == vc.NARROWEST
    assert vc.next_width(16, np.array([80, 0, 0, 0, 0, 5, 9, 6, *[0] * 9, 0])) == 6


@pytest.mark.parametrize("sent", [vc.SENT, 0])
def test_defined_cases(spark, monkeypatch, sent):
    monkeypatch.setattr(vc, "SENT", sent)
    nan, inf = float("nan"), float("inf")
    good = [[float(k), 1.0, -0.5, 2.0] for k in range(6)]
    rows = [(k, v, None if k % 2 else 5) for k, v in enumerate(good)] + [(None, good[2], 5), (3, good[3], None), (3, [9.0, 9.0, 9.0, 9.0], 5)]
    bad = [(20, None, 1), (21, [1.0, None, 2.0, 3.0], 1), (22, [nan, 1.0, 1.0, 1.0], 1), (23, [inf, 1.0, 1.0, 1.0], 1), (24, [1.0, -inf, 1.0, 1.0], 5)]
    odd = [(30, [], 5), (31, [1.0], None), (32, [1.0] * 8, 7)]
    schema = "vec_id bigint, embedding array<float>, label int"
    docs = spark.createDataFrame(rows + bad + odd, schema).selectExpr("*", "vec_id AS `a.b`", "label AS code", "1 AS _c0", "2 AS _id")
    found = vc.codes(docs, carry=("vec_id", "a.b", "label", "code", "_c0", "_id"), entries=4).collect()
    assert found[0].__fields__ == ["vec_id", "a.b", "label", "_c0", "_id", "code", "error", "label_error", "codebooks_sha256"]
    assert len(found) == len(rows) + len(odd)
    assert all(r["code"] is None and r["error"] is None and r["label_error"] is None for r in found if r["vec_id"] in (30, 31, 32))
    want, digest = plain([(i, v) for i, v, _ in rows], entries=4)
    coded = [r for r in found if r["code"] is not None]
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted([(r["vec_id"], r["code"], r["error"]) for r in coded], key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in found} == {digest}
    for label in (5, None):
        assert {r["label_error"] for r in coded if r["label"] == label} == {sum(r["error"] for r in coded if r["label"] == label)}
    for none in (docs.where("vec_id > 100"), docs.where("vec_id = 30"), docs.where("vec_id = 20")):
        assert [r["code"] for r in vc.codes(none).collect()] == [None] * none.where("size(embedding) = 0").count()


def test_what_cannot_be_measured(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    with pytest.raises(ValueError, match="equal parts"):
        vc.codes(spark.createDataFrame([(1, [1.0] * 6, 1)], schema))
    with pytest.raises(Exception, match="64 bits"):
        vc.codes(spark.createDataFrame([(1, [1e30] * 8, 1)], schema)).collect()
