import itertools
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import chains, hmm


def brute_chain(emit, initial, move):
    """Weight of all state paths, posteriors and expected transitions of one chain, path by path."""
    n, k = emit.shape
    total, post, pairs = 0.0, np.zeros((n, k)), np.zeros((k, k))
    for path in itertools.product(range(k), repeat=n):
        w = initial[path[0]] * emit[0, path[0]]
        for t in range(1, n):
            w *= move[path[t - 1], path[t]] * emit[t, path[t]]
        total += w
        for t, s in enumerate(path):
            post[t, s] += w
        for a, b in itertools.pairwise(path):
            pairs[a, b] += w
    return total, post / total, pairs / total


def test_recursions_against_all_paths():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 1, 6, 4, 2])
    emit = rng.random((lengths.sum(), 3))
    initial, move = rng.random(3), rng.random((3, 3))
    layout = chains.Layout(lengths)
    e = layout.spread(emit)
    alpha, scale = chains.forward(layout, e, initial, move)
    beta = chains.backward(layout, e, scale, move)
    post = (alpha * beta)[layout.place]
    want_pairs, at = np.zeros((3, 3)), 0
    for i, n in enumerate(lengths):
        total, p, pairs = brute_chain(emit[at : at + n], initial, move)
        assert math.isclose(chains.totals(layout, scale)[i], math.log(total))
        assert np.allclose(post[at : at + n], p)
        want_pairs += pairs
        at += n
    assert np.allclose(chains.pair_counts(layout, alpha, beta, e, scale, move), want_pairs)


def test_packs_cover_every_chain_once():
    lengths = np.array([5, 0, 900, 2, 3, 1, 700])
    got = sorted(i for part in chains.packs(lengths, 10) for i in part.tolist())
    assert got == [0, 2, 3, 4, 5, 6]


ROWS = [(i, f"the Cat {w} sat\n on é{w} mat") for i, w in enumerate(["red", "blue", "red", "a", "b", "c", "d", "e"] * 3)]
ROWS += [(100, None), (101, ""), (102, " \t"), (None, "the cat"), (5, ROWS[5][1]), (103, "word " * 5000), (104, "never seen ünseen")]


def test_base_score_and_counts_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS word", "1 AS n")
    got = hmm.score(docs, rounds=1, states=2).collect()
    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = lambda t: [*(t or "").lower().encode().split(), b""]
    count = Counter(w for i, t in ROWS if not held(i) for w in toks(t))
    n, v = sum(count.values()), len(count)
    want = [(i is None, i or 0, held(i), len(toks(t)), sum(count[w] > 0 for w in toks(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for i, t in ROWS]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_no_training_rows(spark):
    assert hmm.score(spark.createDataFrame([], "doc_id long, text string"), rounds=1).count() == 0
    held = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    row = hmm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), rounds=1).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_score_against_all_state_paths(spark):
    """With few classes and known words, so that all kinds of words occur: the score from the fitted model, path by path, in plain Python."""
    from pyspark.sql import functions as F

    texts = [(i, t) for i, t in ROWS if t is None or len(t) < 60]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = docs.select("doc_id", (hmm.fold(F.col("doc_id"), 7) == 2).alias("held_out"), F.col("text").cast("binary").alias("body"))
    *_, vocab, _, model = hmm.fitted(rows, 2, 2, own=3, known=6)
    toks = lambda t: [*(t or "").lower().encode().split(), b""]
    count = Counter(w for i, t in texts if crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in toks(t))
    own = {w: k for w, k in vocab.number.items() if k < vocab.n_own}
    assert len(own) == 4 and len(vocab.number) <= 7
    shared: dict = {}
    for w, n in count.items():
        if w not in own:
            c = shared.setdefault(hmm.class_of_rare(w), [0, 0])
            c[0] += n
            c[1] += 1
    want = []
    for i, t in texts:
        cls, logs = [], 0.0
        for w in toks(t):
            if w in own:
                cls.append(own[w])
            else:
                b = hmm.class_of_rare(w)
                cls.append(vocab.n_own + b)
                n, v = shared.get(b, (0, 0))
                logs += math.log10((count[w] + 1) / (n + v + 1))
        want.append((str(i), str(t), round(math.log10(brute_chain(model.emit[cls], model.initial, model.move)[0]) + logs, 6)))
    got = [(str(r.doc_id), round(r.score, 6)) for r in hmm.score(docs, rounds=2, states=2, own=3, known=6).collect()]
    assert sorted(got) == sorted((i, s) for i, _, s in want)


def test_long_texts_in_pieces_as_if_whole(monkeypatch):
    rng = np.random.default_rng(9)
    model = hmm.first_model([rng.integers(0, 6, 40).astype(np.uint16) for _ in range(5)], 6, states=3, rounds=3)
    sequences = [rng.integers(0, 6, n).astype(np.uint16) for n in (50, 7, 1, 23)]
    whole, cut = hmm._zeros(3, 6), hmm._zeros(3, 6)
    hmm._expected(model, sequences, whole)
    layout = chains.Layout(np.array([50]))
    total = chains.totals(layout, chains.forward(layout, model.emit[sequences[0].astype(int)], model.initial, model.move)[1])[0]
    monkeypatch.setattr(hmm, "PIECE", 8)
    hmm._expected(model, sequences, cut)
    for a, b in zip(whole, cut, strict=True):
        assert np.allclose(a, b)
    assert math.isclose(hmm.log_total(model, sequences[0]), total)


def test_long_documents_alone_still_start_the_model(spark, monkeypatch):
    monkeypatch.setattr(hmm, "START_TOKENS", 5)
    seen = []
    plain = hmm.first_model
    monkeypatch.setattr(hmm, "first_model", lambda sample, *a, **k: seen.extend(sample) or plain(sample, *a, **k))
    docs = spark.createDataFrame([(i, "a b c d e f g h i j") for i in range(30)], "doc_id long, text string")
    assert hmm.score(docs, rounds=1, states=2).count() == 30
    assert len(seen) > 20 and all(len(x) == 5 for x in seen)


def test_matrices_of_the_model_sum_to_one():
    model = hmm.first_model([np.array([1, 2, 0], np.uint16), np.array([2, 1, 2, 0], np.uint16)], 3, states=2, rounds=3)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and math.isclose(model.initial.sum(), 1)


@pytest.mark.parametrize("rounds", [4])
def test_rounds_raise_the_likelihood(rounds):
    rng = np.random.default_rng(0)
    sample = [rng.integers(1, 6, 20).astype(np.uint16) + 5 * (i % 2) for i in range(30)]
    lengths = np.array([len(s) for s in sample])
    layout = chains.Layout(lengths)
    cls = layout.spread(np.concatenate(sample)).astype(int)

    def fit(k):
        model = hmm.first_model([s.astype(np.uint16) for s in sample], 11, states=2, rounds=k)
        return chains.totals(layout, chains.forward(layout, model.emit[cls], model.initial, model.move)[1]).sum()

    assert fit(rounds) > fit(1)
