"""Redaction and keys given twice against Python's own JSON reader; batches that come in whole or not at all."""

import copy
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import json_walk as walk
from tidemark.operators import imports


def shown(value, field=""):
    """The rules over a value that has been read."""
    if isinstance(value, dict):
        return {k: shown(v, k) for k, v in value.items() if not any(w in k.lower() for w in walk.FORBIDDEN)}
    if isinstance(value, list):
        return [shown(v, field) for v in value]
    return walk.public_text(value, field) if isinstance(value, str) else value


def name(field, value):
    return "[redacted]-" + hashlib.sha256(f"{field}\0{value}".encode()).hexdigest()[:16]


def test_texts():
    assert walk.public_text("My Portfolio holds 5 shares; coshares cost", "title") == "My [redacted] holds 5 [redacted]; coshares cost"
    assert walk.public_text("US:COST", "asset_key") == "US:COST" and walk.public_text("cost", "topic_key") == name("topic_key", "cost")
    assert walk.public_text("a/account/1", "Source_URL") == name("source_url", "a/account/1") and walk.public_text("accounts", "id") == "accounts"
    assert walk.public_text("x portfolio", "any_key") == name("any_key", "x portfolio")


def nested(rng, depth):
    words = ["shares", "Portfolio", "cost", "plain", "accounting", "é\n\"q\\", "US:COST", "a quantity of"]
    keys = ["id", "title", "avg_cost", "Shares", "asset_key", "tickers", "nested", "x_url", "my\"key", "ACCOUNTS"]
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([*words, 1, -2.5e3, True, None, ""])
    if rng.random() < 0.5:
        return [nested(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(keys): nested(rng, depth - 1) for _ in range(rng.randint(0, 5))}


@pytest.mark.parametrize("indent", [None, 2])
def test_redaction_of_any_shape(indent):
    rng = random.Random(4)
    for _ in range(400):
        value = nested(rng, 6)
        text = json.dumps(value, indent=indent, ensure_ascii=rng.random() < 0.5)
        assert json.loads(walk.redact(text)) == shown(value), text


def test_depth_and_faults():
    deep = "[" * 50_000 + '{"cost": {"a": [1, 2]}, "title": "shares"}' + "]" * 50_000
    assert walk.redact(deep) == "[" * 50_000 + '{"title":"[redacted]"}' + "]" * 50_000
    assert walk.redact('{"a": NaN, "b": [Infinity, 1]}') == '{"a":null,"b":[null,1]}'
    for bad in ("", "{", '{"a"}', "[1,]", "{,}", '{"a":1,}', '["a" "b"]', "[1]]", '{"a":tru}', "'a'", '{"a":1 "b":2}', '"', "[01]", "1 2"):
        assert walk.redact(bad) is None and walk.repeated_key(bad) == " ", bad


def test_keys_given_twice():
    def pairs(found):
        seen = set()
        for k, _ in found:
            if k in seen:
                raise KeyError(k)
            seen.add(k)
        return dict(found)

    rng = random.Random(8)

    def text(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(['1', '"x"', "null"])
        if rng.random() < 0.4:
            return "[" + ",".join(text(depth - 1) for _ in range(rng.randint(0, 3))) + "]"
        return "{" + ",".join(f'"{rng.choice(["a", "b", "c", "d", "e", "f", "g", chr(92) + "u0061"])}": {text(depth - 1)}' for _ in range(rng.randint(0, 3))) + "}"

    for _ in range(600):
        t = text(5)
        try:
            json.loads(t, object_pairs_hook=pairs)
            want = None
        except KeyError as error:
            want = error.args[0]
        assert walk.repeated_key(t) == want, t


def test_columns(spark):
    given = ['{"a": "ok"}', '{"cost": 1, "b": 2}', '{"\\u0063ost": 1}', "no json cost", None]
    got = [r[0] for r in spark.createDataFrame([(k, g) for k, g in enumerate(given)], "k int, p string").orderBy("k").select(walk.redacted(F.col("p"))).collect()]
    assert got == ['{"a": "ok"}', '{"b":2}', "{}", None, None]


GOOD = {
    "schema_version": 1, "snapshot_date": "2026-07-01", "generated_at": "2026-07-01T08:00:00+08:00", "source_as_of": "2026-06-30T23:50:00Z",
    "sections": {s: [] for s in imports.SECTIONS} | {"macro": [{"title": "Fed holds", "source_url": "https://e.com/a", "source_tier": "media", "source": "x", "published_at": "2026-06-30T20:00:00Z"}], "ai": [{"title": "模型", "source_url": "http://e.org", "source_tier": "official", "fetched_at": "2026-06-30T21:00:00Z"}]},
}
NOW = "2026-07-01 00:10:00"


def changed(**values):
    out = copy.deepcopy(GOOD)
    item = out["sections"]["macro"][0]
    for k, v in values.items():
        where = item if k in imports.ITEM_FIELDS or k == "odd" else out
        if v is KeyError:
            del where[k]
        else:
            where[k] = v
    return json.dumps(out, ensure_ascii=False)


CASES = [
    (changed(), None), (None, "payload must be an object"), ("[]", "payload must be an object"), ("{", "payload must be an object"), (changed().replace('"schema_version"', '"schema_version": 1, "schema_version"'), "duplicate JSON key: schema_version"),
    (changed().replace('"title": "模型"', '"title": "模型", "title": "x"'), "duplicate JSON key: title"), (changed(extra=1, more=2), "payload contains unsupported fields: extra, more"), (changed(source_as_of=KeyError, snapshot_date=KeyError), "payload is missing required fields: snapshot_date, source_as_of"),
    (changed(schema_version=2), "schema_version must be 1"), (changed(snapshot_date="2026-7-1"), "snapshot_date must be an ISO-8601 date"), (changed(generated_at="2026-07-01T08:00:00"), "generated_at must be a time with an offset, not in the future"),
    (changed(generated_at="2026-07-01T09:00:00+08:00"), "generated_at must be a time with an offset, not in the future"), (changed(snapshot_date="2026-06-30"), "snapshot_date must match generated_at in Asia/Shanghai"),
    (changed(generated_at="2026-07-01T07:30:00+08:00"), "source_as_of cannot be after generated_at"), (changed(sections={"macro": []}), "invalid sections (missing: ai, finance, investors, technology, world)"),
    (changed(sections=GOOD["sections"] | {"x": []}), "invalid sections (unknown: x)"), (changed(sections=[]), "sections must be an object"), (changed(sections=GOOD["sections"] | {"world": GOOD["sections"]["ai"] * 81}), "sections.world contains too many items"),
    (changed(sections={s: GOOD["sections"]["ai"] * 60 for s in imports.SECTIONS}), "payload contains too many items"), (changed(odd=1), "sections.macro[0] contains unsupported fields: odd"), (changed(title=" "), "sections.macro[0].title must be a text of bounded length"),
    (changed(source_url="http://localhost/a"), "sections.macro[0].source_url must be a public http url"), (changed(source_url="ftp://e.com"), "sections.macro[0].source_url must be a public http url"), (changed(source_tier="rumour"), "sections.macro[0].source_tier must be one of official, first_party, media, discovery"),
    (changed(published_at=KeyError), "sections.macro[0] requires published_at or fetched_at"), (changed(published_at="yesterday"), "sections.macro[0].published_at must be a time with an offset, not in the future"), (changed(why="a", why_it_matters="b"), "sections.macro[0] cannot provide conflicting why and why_it_matters values"),
    (changed(period_end="2026-06-01", data_as_of="2026-06-02"), "sections.macro[0] contains conflicting effective_at, period_end or data_as_of values"), (changed(title="!!!"), "sections.macro[0].title has no searchable content"), (changed(fetched_at="2026-06-30T23:51:00Z"), "item fetched_at cannot be after source_as_of"),
    (json.dumps({"a": "x" * (imports.MOST_BYTES + 1)}), "briefing file exceeds the supported size"),
]


def files(spark, rows):
    return spark.createDataFrame([(f"f{k:02}", body) for k, body in rows], "file string, body string").repartition(3)


def test_reasons(spark):
    got = {r["file"]: r["reason"] for r in imports.checked(files(spark, enumerate(b for b, _ in CASES)), F.lit(NOW).cast("timestamp")).collect()}
    assert [got[f"f{k:02}"] for k in range(len(CASES))] == [reason for _, reason in CASES]


def test_a_batch_comes_in_whole_or_not_at_all(spark, tmp_path):
    store = str(tmp_path)
    assert imports.import_batch(files(spark, [(1, changed()), (2, changed(title="Other"))]), store, 1, F.lit(NOW).cast("timestamp")) == imports.Verdict(2, 0, None, None)
    bad = imports.import_batch(files(spark, [(3, changed()), (4, changed(odd=1)), (5, changed(schema_version=3))]), store, 2, F.lit(NOW).cast("timestamp"))
    assert bad == imports.Verdict(3, 2, "f04", "sections.macro[0] contains unsupported fields: odd")
    rows = imports.accepted(spark, store).collect()
    assert sorted((r["file"], r["section"], r["title"], r["time_status"]) for r in rows) == sorted([("f01", "macro", "Fed holds", "verified"), ("f01", "ai", "模型", "fetched_only"), ("f02", "macro", "Other", "verified"), ("f02", "ai", "模型", "fetched_only")])
    # Mended and run again, the batch counts; run again as it is, it changes nothing.
    for _ in range(2):
        assert imports.import_batch(files(spark, [(3, changed()), (4, changed())]), store, 2, F.lit(NOW).cast("timestamp")).broken == 0
        assert imports.accepted(spark, store).count() == 8
    assert imports.import_batch(files(spark, []), store, 3, F.lit(NOW).cast("timestamp")).files == 0

