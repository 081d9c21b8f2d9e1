"""Classes of long texts only, scores under other partitionings, and columns with awkward names."""

import random

import pytest

from tidemark.llm import hmm, language, licences, near_texts, simhash, toxicity
from tidemark.llm.common import fold

SYLLABLES = {"aa": "bo ka lu mi ta re".split(), "bb": "schri gen heit ung ver zu".split(), "cc": "eau tion ille oux que le".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(2, 4))) for _ in range(n))


def held(spark, docs, parts):
    return {r["doc_id"] for r in docs.where(fold(docs.doc_id, parts) == 0).select("doc_id").collect()}


def test_a_language_of_long_texts_is_learned(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang, rng.randint(3600, 4400) if lang == "cc" else rng.randint(20, 90)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    assert min(len(t) for _, t, lang in rows if lang == "cc") > language.SAMPLE_BYTES
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    out = held(spark, docs, 5)
    assert sum(got[i] == lang for i, _, lang in rows if i in out) >= 0.95 * len(out)


@pytest.mark.parametrize("long", ["all", "toxic"])
def test_long_toxic_texts_are_caught(spark, long):
    rng = random.Random(5)
    bad = ["vilescum", "wretchfool", "foulbrute"]
    rows, labels = [], []
    for i in range(300):
        y = int(i % 3 == 0)
        words = text(rng, "aa", rng.randint(4000, 5000) if long == "all" or y else rng.randint(30, 90)).split()
        if y:
            for w in bad:
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    tagger = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.tag(docs, tagger).collect()}
    out = held(spark, docs, 5)
    assert sum(got[i] == y for i, y in labels if i in out) >= 0.95 * len(out)


def test_scores_do_not_depend_on_the_split(spark):
    rng = random.Random(7)
    rows = [(i, text(rng, rng.choice(["aa", "bb"]), rng.randint(0, 400))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, other = ({r["doc_id"]: r["score"] for r in hmm.score(df, rounds=3, states=4).collect()} for df in (docs.repartition(2), docs.repartition(7, "text")))
    assert one.keys() == other.keys() and max(abs(one[i] - other[i]) for i in one) < 1e-6


def test_awkward_names(spark):
    rows = [(1, "one two three four five six seven", "x", 2, "k"), (2, "one two three four five six seven", "y", 3, "l"), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` string, `c``d` int, digest string")
    found = licences.scan(docs)
    assert found.columns == ["doc_id", "text", "a.b", "c`d", "digest", "licence", "notices"] and found.count() == 3
    signed = simhash.fingerprints(docs, carry=("doc_id", "a.b", "c`d"))
    assert signed.columns == ["doc_id", "a.b", "c`d", "fp"] and signed.count() == 3
    kept = near_texts.unique_texts(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
