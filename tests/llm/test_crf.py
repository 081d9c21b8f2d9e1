import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import crf, language, toxicity


def brute_words(text):
    """(letters lower-cased, start) of the runs of letters of a text's bytes."""
    out, at = [], None
    data = text.encode()
    for i, b in enumerate(data + b" "):
        letter = 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
        if letter and at is None:
            at = i
        if not letter and at is not None:
            out.append((bytes(x + 32 if 65 <= x <= 90 else x for x in data[at:i]), at))
            at = None
    return out


TEXTS = ["Hello, wörld! a", "", "...", "É été", "x", "one-two3four", "ü" * 50]


def batch(texts):
    raw = [t.encode() for t in texts]
    return crf.Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))


def test_words_and_hashes():
    words = batch(TEXTS)
    want = [(i, w, at) for i, t in enumerate(TEXTS) for w, at in brute_words(t)]
    starts = np.concatenate(([0], np.cumsum([len(t.encode()) for t in TEXTS])))
    assert list(zip(words.text.tolist(), (words.start - starts[words.text]).tolist(), strict=True)) == [(i, at) for i, _, at in want]
    assert words.hashes().tolist() == [crf.word_hash(w) for _, w, _ in want]
    assert [h > 0 for h in words.hashes(4).tolist()] == [len(w) >= 4 for _, w, _ in want]


def test_texts_that_touch_stay_apart():
    words = batch(["ab", "cd"])
    assert words.per_text.tolist() == [1, 1]


def test_null_and_sliced_columns():
    data, cuts = crf.texts_of(pa.array(["skip", "ab", None, "cde"])[1:])
    assert bytes(data) == b"abcde" and cuts.tolist() == [0, 2, 2, 5]


def test_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    model = crf.RandomField.empty(["a", "b"], np.array([crf.word_hash(b"dog")], np.uint64), (2,))
    for name in ("gram", "end", "head", "lex", "bias"):
        w = getattr(model, name)
        w[...] = rng.normal(0, 0.3, w.shape)
    model.lex[-1] = 0
    model.move, model.first = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    texts = ["the dog runs", "cat", "", "a b c d e"]
    scores = model.scores(batch(texts)).astype(float)
    at, want = 0, {}
    for i, t in enumerate(texts):
        n = len(brute_words(t))
        weights = np.zeros((n, 2))
        for path in itertools.product(range(2), repeat=n):
            w = math.exp(sum(scores[at + k, s] for k, s in enumerate(path)) + (model.first[path[0]] if path else 0) + sum(model.move[a, b] for a, b in itertools.pairwise(path)))
            for k, s in enumerate(path):
                weights[k, s] += w
        want[i] = weights / weights.sum(axis=1, keepdims=True) if n else weights
        at += n
    for chosen, n, *_, found in crf.marginals(model, pa.array(texts)):
        first = 0
        for i, k in zip(chosen.tolist(), n.tolist(), strict=True):
            assert np.allclose(found[first : first + k], want[i], atol=1e-5)
            first += k
        for i in chosen.tolist():
            want.pop(i)
    assert all(len(v) == 0 for v in want.values())


def lang_rows():
    en, de = ["the cat and this", "with that thing", "there is the", "shining whale"], ["der hund und", "ich schlafe nicht", "über die straße", "und das ist"]
    rows = [(i, f"{(en if i % 2 else de)[i % 4]} {(en if i % 2 else de)[(i + 2) % 4]} {i}", "en" if i % 2 else "de", "s") for i in range(120)]
    return rows + [(500, None, None, None), (501, "", "en", None), (502, "12 34!", "de", None), (None, "the thing", None, "s"), (503, "the cat " * 3000, "en", "s"), (1, rows[1][1], "en", "s")]


def test_language(spark):
    docs = spark.createDataFrame(lang_rows(), "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS score", "2 AS Lang_Pred", "3 AS _letter", "4 AS _body")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert len(language.identify(docs).collect()) == len(lang_rows())
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (500, 501, 502))
    held = [r for r in lang_rows() if r[2] and r[1] and r[0] is not None and any(c.isalpha() for c in r[1])]
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_all_of_many_languages_are_learned(spark):
    """Seventy languages of a few words each, and texts that pass from one to another."""
    words = lambda k: [f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}{b}" for a, b in zip("bdfgh", "aeiou", strict=True)]
    rows = [(1000 * k + i, " ".join(words(k)[(i + j) % 5] for j in range(8)), f"l{k:02}") for k in range(70) for i in range(12)]
    mixed = " ".join(words(3) * 3 + words(40) * 3)
    docs = spark.createDataFrame([*rows, (99_999, "é. " + mixed, None)], "doc_id long, text string, lang string")
    got = language.identify(docs, ("doc_id", "lang", "text")).collect()
    assert {r.lang_pred for r in got} == {f"l{k:02}" for k in range(70)}
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(rows)
    runs = next(r for r in got if r.doc_id == 99_999).runs
    assert {"l03", "l40"} <= {x.lang for x in runs}
    for r in got:
        assert all(x.start < x.end and r.text[x.start : x.end].strip() == r.text[x.start : x.end] for x in r.runs)


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identify(docs).first().lang_pred == "und"
    assert language.identify(docs.limit(0)).count() == 0


def toxic_rows():
    bad = ["vilest", "vilesome", "grotty"]
    clean = [(i, f"a calm day number {i} with rain and tea", 0) for i in range(150)]
    toxic = [(1000 + i, f"you {bad[i % 3]} person number {i} have {bad[(i + 1) % 3]} tea", 1) for i in range(60)]
    return clean + toxic


def test_toxicity(spark):
    rows = toxic_rows()
    extra = [(5000, None), (5001, ""), (None, "you grotty one, vilest of all"), (5002, "rain " * 5000), (1000, rows[150][1]), (5003, "é ô grotty vilesque")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS Predicted", "3 AS _body")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (99999, 1), (1000, 0)], "doc_id long, toxic int")
    tagger = toxicity.train(docs, labels)
    got = toxicity.tag(docs, tagger, ("doc_id", "text")).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert sum(by[i].predicted == y for i, _, y in rows) >= 0.97 * len(rows)
    assert by[5000].predicted == by[5001].predicted == by[5002].predicted == 0 and by[None].predicted == 1
    for r in got:
        assert 0 <= r.score <= 1
        for s in r.spans:
            assert r.text[s.start : s.end].isalpha()
    assert "grotty" in [by[5003].text[s.start : s.end] for s in by[5003].spans]


def test_typical_words_against_plain_counts(spark):
    """Which keys pass the test, from counts made in plain Python."""
    rng = np.random.default_rng(4)
    rows = [(float(t), float(t + c)) for t in range(12) for c in range(0, 30, 3)]
    frame = spark.createDataFrame(rows, "t double, n double").where("n > 0")
    for rate, tested in ((0.1, 50), (0.5, 2000), (float(rng.random()), 10)):
        got = {(r.t, r.n) for r in frame.where(toxicity.typical(frame.t, frame.n, rate, tested)).collect()}
        want = set()
        for t, n in rows:
            if n and t >= toxicity.LEAST and t / n > rate and t * (1 - rate) >= toxicity.LIFT * rate * (n - t):
                p = t / n
                bound = n * (p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0))
                if bound >= math.log(tested / toxicity.ALPHA):
                    want.add((t, n))
        assert got == want


def test_one_toxic_text_in_many_copies_makes_no_word_toxic(spark):
    rows = [(i, f"quiet day {i} rain", 0) for i in range(120)] + [(500 + i, f"vilest thing {i} rain", 1) for i in range(40)] + [(900 + i, "vilest harmless gardening", 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(2000, "harmless gardening in rain")], "doc_id long, text string")
    tagger = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.tag(docs, tagger).collect()}
    assert got[2000].predicted == 0 and got[900].predicted == 1 and all(got[i].predicted == 0 for i in range(120))


def test_few_labels_in_a_second_language(spark):
    """Toxic texts without any of the common toxic words are tested among themselves."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abdeghilmnoprst"), 5))
    rows = [(i, " ".join(word() for _ in range(12)), 0) for i in range(300)]
    rows += [(400 + i, " ".join([*(word() for _ in range(6)), "vilest", *(word() for _ in range(6))]), 1) for i in range(40)]
    rows += [(600 + i, " ".join([*(word() for _ in range(6)), f"qrux{i}", *(word() for _ in range(6))]), 1) for i in range(9)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    tagger = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.tag(docs, tagger).collect()}
    assert sum(got[i] for i in range(600, 609)) >= 8 and sum(got[i] for i in range(300)) == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    tagger = toxicity.train(docs, none)
    assert tagger is None
    row = toxicity.tag(docs, tagger, ("doc_id",)).first()
    assert (row.score, row.predicted, row.spans) == (0.0, 0, [])


@pytest.mark.parametrize("seed", range(3))
def test_pieces_cover_all_texts(seed):
    rng = np.random.default_rng(seed)
    cuts = np.concatenate(([0], np.cumsum(rng.integers(0, 50, 40))))
    got = list(crf.pieces(np.zeros(cuts[-1], np.uint8), cuts, 60))
    assert [a for a, _ in got] == [0, *[b for _, b in got][:-1]] and got[-1][1] == 40
