"""Mixing, decontamination, licences, chat and the pipeline against plain Python."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, decontaminate, licences, mixing, near_texts


def brute_targets(sizes):
    """{source: words} by filling again and again what the limits leave over."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = Fraction(3, 2) * sum(sizes.values())
    full: set = set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: Fraction(2 * sizes[s]) if s in full else left * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def mix_rows(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "é", "Z", "", None, "hot", "hot", "hot"])) for i in range(400)]
    return rows + [(900, None, "a"), (901, "x " * 9000, "b"), (None, "a b", "a"), (None, "a b", "a"), (5, rows[5][1], rows[5][2]), (902, "\t\n", "only")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = mix_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS copies", "'x' AS Size", "2 AS target", "3 AS _full", "4 AS _bucket")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes: dict = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(want[r.source]))
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    largest = max(len((t or "").split()) for _, t, _ in rows)
    for s, t in want.items():
        assert abs(taken[s] - float(t)) <= 2 * min(largest, sizes[s]) + 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in again)
    assert mixing.mix(docs).columns == ["doc_id", "text", "source", "_full", "_bucket", *mixing.RESULTS]
    assert sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs, carry=("doc_id",)).collect()) == sorted((str(r.doc_id), r.taken) for r in got)
    assert mixing.emitted(mixing.mix(docs)).count() == sum(r.copies for r in got)


def test_rows_of_one_id_keep_their_copies_between_runs(spark):
    rows = [(7 if i % 2 else None, f"w{i} x y", "a" if i % 3 else "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted((r.text, r.copies) for r in mixing.mix(docs.repartition(n)).collect()) for n in (2, 9)]
    assert runs[0] == runs[1] and {c for _, c in runs[0]} == {1, 2}


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0)] * 2


def brute_hits(text, items, width=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = split(text)
    hit, found = set(), set()
    for item, t in items:
        own = split(t)
        for k in range(max(1, len(own) - width + 1)) if own else ():
            w = own[k : k + width]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def test_decontaminate(spark):
    rng = random.Random(3)
    vocab = ["alpha", "BETA", "ga1", "é", "δ-x", "to", "be", "or", "not", "x9"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(n)) for i, n in enumerate((40, 25, 13, 14, 12, 3, 2))] + [(7, "solo"), (8, None), (9, "..."), (10, "a"), (11, text(30)), (None, "un nombre nul ici")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    docs += [(100, items[0][1]), (101, text(400) + ", " + items[1][1].upper() + "! " + text(5)), (102, None), (103, ""), (104, " ".join(items[11][1].split()[3:20])), (None, "solo"), (105, "A a, a."), (105, "un nombre NUL ici"), (106, items[0][1] + " " + items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS n_hit", "1 AS owners", "'x' AS digest", "2 AS _items")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), *brute_hits(t, items)) for i, t in docs)
    for size, at_once in ((1 << 20, 1 << 20), (200, 1 << 20), (200, 1), (1 << 20, 1)):
        got = decontaminate.decontaminate(d, b, block_bytes=size, pass_bytes=at_once).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want
        assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) and r.n_hit == sum(s.n_words for s in r.spans) for r in got)
    assert decontaminate.decontaminate(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abc ", min_size=1, max_size=60).map(str.encode), min_size=1, max_size=8, unique=True), st.text("abc ", max_size=300).map(str.encode))
def test_wu_manber(patterns, text):
    got = sorted(decontaminate.WuManber({p: [0] for p in patterns}).find(text))
    assert got == sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))


def test_licences(spark):
    mit = licences.TEXTS["MIT"]
    changed = "Copyright 2020 Jane\n" + mit.upper().replace("LICENSE", "Licence").replace(",", " ;").split("COPYRIGHT (C)")[0] + "© X\n" + mit.split("holders>")[1]
    rows = [(1, mit), (2, changed), (3, "no licence here"), (4, None), (5, ""), (6, "text\n  Licensed under the apache LICENCE version 2.0\nAll rights reserved."), (None, mit), (1, "x " * 40_000), (7, mit + " and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' AS line", "0 AS digest")
    got = sorted(((str(r.doc_id), len(r.text or "")), r.licence, r.notices) for r in licences.scan(docs).collect())
    want = {1: "MIT", 2: "MIT", None: "MIT"}
    assert got == sorted(((str(i), len(t or "")), want.get(i) if (t or "")[:2] != "x " else None, ["Apache-2.0", "proprietary"] if i == 6 else []) for i, t in rows)
    assert licences.scan(docs.limit(0)).count() == 0


def test_whole_texts_known_by_digest(spark):
    """Complete licences where the system has them, in other letters and with a copyright line put before."""
    import pathlib

    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(n, "Copyright 2001 A. Person\n" + (folder / f).read_text().upper().replace(" ", "  ")) for f, n in names.items() if (folder / f).is_file()]
    if not rows:
        pytest.skip("no licences here")
    got = licences.scan(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [r.licence for r in got] == [r.name for r in got]


def test_canonical_text(spark):
    """Digests against plain Python: capitals of other scripts, carriage returns, blank lines, doubled blanks, symbols within words."""
    import hashlib

    def plain(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        low = re.sub(r"(?m)^[^a-z0-9\n©]*(copyright|\(c\)|©)[^\n]*", " ", low)
        words = re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F©]+", low)
        return hashlib.sha256(" ".join(licences.SPELLINGS.get(w, w) for w in words if w).encode()).hexdigest()

    texts = ["Éa ÄB Σς İI", "a\rCopyright x\nb", "A  b\n\n \nC\t-d", "  \n", "Licence\nLICENCE licence", "(C) gone\nstays © here", "x\x1cy\n", "straße Ünder\r\n© z", None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.digest for r in licences.scan(docs).collect()}
    assert got == {t: plain(t) for t in texts}


TOOLS = {"sum": {"a": ("integer", True), "b": ("number", False)}, "say": {"text": ("string", True)}}


def test_tool_calls(spark):
    calls = [
        ("c1", "sum", '{"b": 2.5, "a": 1}', []), ("c2", "say", '{"text":"é\\n\\"x\\""}', ["c1"]), ("c3", "say", '{"text": 5}', ["c2", "c1"]), ("c4", "nope", "{}", ["c3"]), ("c5", "sum", '{"x": 1}', ["lost"]),
        ("c6", "sum", "[1]", ["c7"]), ("c7", "sum", "not json", ["c6"]), ("c8", "say", None, ["c7"]), ("c9", "sum", '{"a": 1}', ["c4", "c2", None]), (None, "say", '{"text": ""}', ["c1"]), ("c1", "sum", '{"a": 1}', []),
    ]
    results = [("c1", 2, "late"), ("c1", 1, "early"), ("c2", 3, None), ("zz", 1, "none"), (None, 1, "x")]
    c = spark.createDataFrame(calls, "call_id string, name string, arguments string, after array<string>").selectExpr("*", "1 AS level", "2 AS node", "3 AS _result", "4 AS lost", "5 AS result")
    r = spark.createDataFrame(results, "call_id string, turn long, content string")
    got = chat.link_tool_calls(c, r, TOOLS).collect()
    assert len(got) == len(calls)
    by = {(x.call_id, x.arguments): x for x in got}
    level = {k[0]: x.level for k, x in by.items()}
    assert level == {"c1": 0, "c2": 1, "c3": 2, "c4": 3, "c5": 0, "c6": None, "c7": None, "c8": None, "c9": 4, None: None}
    errors = {k: x.errors for k, x in by.items()}
    assert errors[("c1", '{"b": 2.5, "a": 1}')] == [] and errors[("c3", '{"text": 5}')] == ["text is not string"] and errors[("c4", "{}")] == ["unknown tool"]
    assert errors[("c5", '{"x": 1}')] == ["missing a", "unknown key", "unknown dependency"] and errors[("c6", "[1]")] == ["not an object"] and errors[("c8", None)] == ["not an object"]
    first = by[("c1", '{"b": 2.5, "a": 1}')]
    assert (first.result_turn, first.n_results, first.valid) == (1, 2, True)
    assert first.message == '{"arguments":{"a":1,"b":2.5},"id":"c1","level":0,"name":"sum","result":"early"}'
    assert by[("c2", calls[1][2])].message == '{"arguments":{"text":"é\\n\\"x\\""},"id":"c2","level":1,"name":"say","result":null}'
    assert chat.link_tool_calls(c.limit(0), r, TOOLS).count() == 0


def test_turns_without_a_conversation_link_nothing(spark, tmp_path):
    from tidemark.llm.query_chat import chats

    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 2, "user", "c"), (None, 0, "user", "d"), (None, 1, "assistant", "e"), (1, 0, "user", "f"), (1, 1, "assistant", "g"), (1, 2, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chats(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all((r.call_id, r.level, r.n_results) == (None, None, 0) for r in got if r.conv_id is None)
    assert sorted((r.turn, r.level, r.n_results, r.errors) for r in got if r.conv_id == 1) == [(0, 0, 1, ""), (2, 1, 0, "missing text,turn is not integer,unknown dependency")]


def test_waves_of_calls_with_several_dependencies(spark):
    names = [f"n{i}" for i in range(12)]
    needs = {(names[i], names[j]) for i in range(12) for j in (i - 1, i - 2) if j >= 0} | {("x", "y"), ("y", "x"), ("z", "y"), ("z", "n3")}
    got = chat.levels(spark.createDataFrame([(n,) for n in [*names, "x", "y", "z"]], "node string"), spark.createDataFrame(sorted(needs), "node string, parent string"))
    assert {r.node: r.level for r in got.collect()} == {**{n: i for i, n in enumerate(names)}, "x": None, "y": None, "z": None}


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    needs = {(names[i], names[rng.randrange(max(0, i - 4), i)]) for i in range(1, 60) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))}
    parents = defaultdict(list)
    for a, b in needs:
        parents[a].append(b)
    want: dict = {}
    for n in names:
        want[n] = 1 + max((want[p] for p in parents[n]), default=-1)
    got = chat.levels(spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(sorted(needs), "node string, parent string"))
    assert {r.node: r.level for r in got.collect()} == want


def jaccard(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_texts(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(80, 200))) for _ in range(40)]
    rows = list(enumerate(base))
    for i in range(20):
        words = base[i].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, base[0].upper()), (201, base[0]), (0, base[0]), (None, base[1]), (300, ""), (301, None), (302, "one two"), (303, "One two"), (304, "word " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS _x", "1 AS root")
    got = near_texts.unique_texts(docs).collect()
    ids = sorted(r.doc_id for r in got)
    near = {100 + i for i in range(20) if jaccard(base[i], dict(rows)[100 + i]) >= 0.85}
    assert len(near) > 10 and not near & set(ids)
    assert [i for i in ids if i < 100] == list(range(40)) and {300, 302, 304} <= set(ids) and not {200, 201, 301, 303} & set(ids)
    assert near_texts.unique_texts(docs.limit(0)).count() == 0


def test_near_texts_that_differ_in_repeats_only(spark):
    rng = random.Random(21)
    rows = []
    for i in range(20):
        body, line = ([f"v{rng.randrange(5000)}" for _ in range(n)] for n in (300, 12))
        few, many = (" ".join(body + line * n) for n in (2, 60))
        assert jaccard(few, many) == 1
        rows += [(i, few), (100 + i, many)]
    got = near_texts.unique_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(20))


def test_near_texts_on_both_sides_of_the_threshold(spark):
    """Texts of 200 words with their ends changed: J just below, at and above 0.8."""
    rng = random.Random(22)
    rows, gone = [], set()
    for i in range(120):
        words = [f"u{rng.randrange(100_000)}" for _ in range(184)]
        changed = 14 + 2 * (i % 12)
        other = words[: 184 - changed] + [f"o{rng.randrange(100_000)}" for _ in range(changed)]
        rows += [(i, " ".join(words)), (1000 + i, " ".join(other))]
        if jaccard(rows[-1][1], rows[-2][1]) >= 0.8:
            gone.add(1000 + i)
    assert 10 < len(gone) < 60 and any(jaccard(rows[2 * i][1], rows[2 * i + 1][1]) == 0.8 for i in range(120))
    got = near_texts.unique_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {i for i, _ in rows} - {r.doc_id for r in got} == gone


def test_near_texts_that_no_shard_proposes(spark, monkeypatch):
    """Pairs that keys, radius and sketch miss are found by the shingles that both must share; here no shard proposes any."""
    monkeypatch.setattr(near_texts, "shard_keys", lambda least: np.random.default_rng(int(least[0])).integers(0, 1 << 62, near_texts.KEYS).tolist())
    monkeypatch.setattr(near_texts, "PROPOSED", 2.0)
    rng, line = np.random.default_rng(3), " ".join(f"common{k}" for k in range(30))
    texts = []
    for _ in range(60):
        words = [f"w{k}" for k in rng.integers(0, 100_000, int(rng.integers(3, 150)))]
        texts.append(" ".join(words) + " " + line)
        for share in (0.02, 0.04, 0.08, 0.2):
            texts.append(" ".join(f"v{rng.integers(0, 100_000)}" if rng.random() < share else w for w in words[: len(words) - int(rng.integers(0, 4))]) + " " + line)
    sets = [set(near_texts.shingle_hashes(t.encode(), near_texts.SHINGLE).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 60 < len(set(root)) < len(texts) - 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in near_texts.unique_texts(docs).collect()) == sorted(set(root))


def test_near_texts_of_a_large_group_meet_in_bounded_blocks(spark, monkeypatch):
    """300 near copies of a text, and 60 texts that share most of it but are no near-duplicates of it or of each other."""
    rng = random.Random(23)
    new = lambda n: [f"u{rng.randrange(1_000_000)}" for _ in range(n)]
    base = new(200)
    rows = [(i, " ".join(base[:-1] + new(1))) for i in range(300)] + [(1000 + i, " ".join(base[:162] + new(38))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met = []
    plain = type(docs).mapInPandas

    def watched(df, *args, **more):
        if "shard" in df.columns:
            met.append(df.groupBy("shard").count().agg(F.max("count")).first()[0] or 0)
        return plain(df, *args, **more)

    monkeypatch.setattr(type(docs), "mapInPandas", watched)
    monkeypatch.setattr(near_texts, "SHARD", 30, raising=False)
    monkeypatch.setattr(near_texts, "BLOCK", 20, raising=False)
    got = near_texts.unique_texts(docs).collect()
    assert sorted(r.doc_id for r in got) == [0, *range(1000, 1060)]
    assert len(met) > 2 and max(met) <= 80


def test_near_texts_of_a_large_cluster_make_no_pairs(spark, monkeypatch):
    """Copies of a text that share two thirds to nine tenths of it: as many classes as all pairs give, and no pairs of those of one cluster."""
    rng = random.Random(31)
    new = lambda n: [f"u{rng.randrange(1_000_000)}" for _ in range(n)]
    base, texts = new(150), []
    for i in range(260):
        changed = rng.randrange(1, 4) if i % 2 else rng.randrange(8, 40)
        texts.append(" ".join(base[: 150 - changed] + new(changed)))
    texts += [" ".join(texts[i].split()[:-6] + new(6)) for i in range(0, 80, 2)]
    sets = [set(near_texts.shingle_hashes(t.encode(), near_texts.SHINGLE).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 20 < len(set(root)) < 200
    made, plain = [], near_texts.stored

    def watched(df, tag):
        made.append((tag, df.count()))
        return plain(df, tag)

    monkeypatch.setattr(near_texts, "stored", watched)
    monkeypatch.setattr(near_texts, "SHARD", 30)
    monkeypatch.setattr(near_texts, "BLOCK", 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_texts.unique_texts(docs).collect()) == sorted(set(root))
    assert sum(n for tag, n in made if tag == "pairs") <= len(texts)


def test_parities_tell_no_near_duplicates_apart():
    rng = np.random.default_rng(4)
    for n in (1, 9, 146, 4000):
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        two = np.unique(np.concatenate((one[n // 10 :], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64))))
        for bits in (256, 1024):
            odd = near_texts.parities([one, two, one], bits)
            assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= len(np.setxor1d(one, two)) and (odd[0] == odd[2]).all()
        assert near_texts.alike(one, two) == (5 * len(np.intersect1d(one, two)) >= 4 * len(np.union1d(one, two)))


def test_pipeline_against_its_stages_in_plain_python(spark, tmp_path):
    """Near-duplicates, contamination and mix recomputed in plain Python from what the two models keep."""
    rng = random.Random(11)
    words = {"en": ["the", "and", "thing", "with", "that", "shower", "weather"], "de": ["der", "und", "nicht", "straße", "schön", "über", "ich"]}
    text = lambda lang: " ".join(rng.choices(words[lang], k=rng.randint(30, 80)))
    rows = [(i, text(lang), lang, f"s{i % 4}") for i in range(160) for lang in ["en" if i % 2 else "de"]]
    items = [(0, text("en")), (1, text("de"))]
    rows += [(500 + i, rows[i][1], rows[i][2], "s9") for i in range(10)] + [(600, items[0][1] + " ending", "en", "s0"), (601, "12 34", "en", "s1"), (602, None, None, None)]
    rows += [(700 + i, f"{text('en')} grotesk vilest {text('en')}", "en", "s1") for i in range(40)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    # Columns of the table that are called like what the stages work with.
    docs = docs.selectExpr("*", "1 AS score", "2 AS predicted", "'p' AS lang_pred", "3 AS target", "4 AS owners", "5 AS items", "6 AS _content", "7 AS root", "8 AS copies")
    labels = [(i, 0, 0) for i in range(160)] + [(700 + i, 0, 1) for i in range(40)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    clean = [i for i in range(160)]
    assert all((r.score, r.predicted, r.lang_pred, r.target, r.owners, r["items"], r._content, r.root) == (1, 2, "p", 3, 4, 5, 6, 7) for r in out)
    assert not kept & {500 + i for i in range(10)} and not kept & {600, 601, 602} and not kept & {700 + i for i in range(40)}
    assert kept <= set(clean) and len(kept) >= 100
    sizes: dict = defaultdict(int)
    survivors = [r for r in rows if r[0] in clean]
    for r in survivors:
        sizes[r[3]] += len(r[1].split())
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in out:
        taken[r.source] += r["size"]
    assert all(abs(taken[s] - float(want[s])) <= 200 for s in sizes)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_duplicates", "decontamination", "mixing"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_word_count_splits_on_ascii_blanks_only(spark):
    rows = spark.createDataFrame([("a b\x0bc",), ("a\u00a0b",), (None,), ("  ",)], "t string").select(mixing.word_count(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == [3, 1, 0, 0]
