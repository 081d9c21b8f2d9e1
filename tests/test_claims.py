"""Claims of headlines by literal cases, and clusters against a greedy union-find in plain Python."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import claims, titles
from tidemark.operators import clusters

NOON = dt.datetime(2026, 7, 1, 12)
CUT = "2026-07-01|rate_cut|fed|25bp,policy_rate"
#: (title, claim of a verified publication that day).
HEADLINES = [
    ("美联储降息25个基点", CUT), ("Fed cuts rates by 25 basis points", CUT), ("The Fed lowered the policy rate by 25.0 bps.", CUT), ("Ｆｅｄ cuts rates 25bps", CUT), ("美联储 宣布 下调基准利率 25 个基点！", CUT),
    ("美联储加息25个基点", "2026-07-01|rate_hike|fed|25bp,policy_rate"), ("PBOC cuts rates by 10 bps", "2026-07-01|rate_cut|pboc|10bp,policy_rate"), ("中国人民银行降息10个基点", "2026-07-01|rate_cut|pboc|10bp,policy_rate"),
    ("OpenAI releases GPT-5.1 model", "2026-07-01|product_release|openai|gpt-5.1,model"), ("OpenAI launches a new reasoning model for enterprise developers", "2026-07-01|product_release|openai|reasoning_model"),
    ("OpenAI发布推理模型", "2026-07-01|product_release|openai|reasoning_model"), ("新推理模型由OpenAI正式发布", "2026-07-01|product_release|openai|reasoning_model"), ("OpenAI releases GPT 6", "2026-07-01|product_release|openai|gpt-6"),
    ("Vance says the Iran conflict is not a war", None), ("JD Vance says the Iran conflict is not a war", "2026-07-01|war_denial|iran,vance|iran_conflict"), ("万斯称伊朗冲突不是战争", "2026-07-01|war_denial|iran,vance|iran_conflict"),
    # Denials, plans, rumours, other times, several deeds and free wordings have none.
    *((t, None) for t in (
        "美联储未降息25个基点", "美联储没有降息25个基点", "美联储暂不降息25个基点", "Fed is not cutting rates by 25 basis points", "Fed will not in September cut rates by 25 basis points", "美联储降息25个基点的传闻不实",
        "Fed unlikely to cut rates by 25 basis points", "Fed rules out cutting rates by 25 basis points", "美联储拒绝降息25个基点", "Fed cuts rates by 25 basis points, not ending QT", "Fed to cut rates by 25 basis points",
        "美联储将降息25个基点", "美联储讨论降息25个基点", "美联储如果降息25个基点", "美联储降息25个基点？", "美联储加息，此前曾降息25个基点", "美联储7月降息25个基点", "OpenAI may release GPT-6", "OpenAI has not released GPT-6",
        "巴菲特增持苹果公司股份", "Markets cheer as Fed cuts rates by 25 basis points", "OpenAI Update", "", None,
    )),
]
ACTIONS = [
    ("美联储降息25个基点", "rate_cut"), ("美联储不会降息25个基点", "rate_cut_denial"), ("Fed hasn't raised rates", "rate_hike_denial"), ("巴菲特增持苹果公司股份", "holding_increase"), ("巴菲特减持苹果公司股份", "holding_decrease"),
    ("OpenAI recalls GPT-5.1 model", "product_recall"), ("OpenAI will not release GPT-5.1 model", "product_release_denial"), ("Fed keeps rates steady", None), ("Buffett refuses to sell its stake", "holding_decrease_denial"),
    ("Iran operation is not a war", "war_denial"), ("nothing at all", None),
]


def column(spark, values, of, kind="string", raw=False):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    if kind == "string":
        df = df.withColumn("v", F.col("v") if raw else claims.plain(F.col("v")))
    return [r[1] for r in df.select("k", of(F.col("v")).alias("x")).orderBy("k").collect()]


def test_headlines(spark):
    none = F.array().cast("array<string>")
    got = column(spark, [t for t, _ in HEADLINES], lambda v: F.array_join(claims.signature(v, F.lit(NOON), none, F.lit("powell")), "|"))
    assert list(zip([t for t, _ in HEADLINES], got, strict=True)) == HEADLINES
    assert set(column(spark, [t for t, _ in HEADLINES], lambda v: claims.signature(v, F.lit(None).cast("timestamp"), none, F.lit("x")))) == {None}


def test_actions(spark):
    assert column(spark, [t for t, _ in ACTIONS], lambda v: claims.action(v)) == [a for _, a in ACTIONS]


def test_titles(spark):
    given = ["美联储宣布加息25个基点", "Fed Raises Rates | Reuters", "快讯：伊朗表示不会 让步 - 路透", "ﬁnance ½", "JD  Vance说：好", "Über alles 50%"]
    assert column(spark, given, lambda v: claims.briefing_title(v)) == ["美联储宣布加息25个基点", "fedraisesrates", "伊朗称不会让步", "finance12", "vance称好", "beralles50"]


def test_day_is_where_the_desk_is(spark):
    times = [dt.datetime(2026, 7, 1, 15, 59), dt.datetime(2026, 7, 1, 16, 0), None]
    assert column(spark, times, claims.day, "timestamp") == ["2026-07-01", "2026-07-02", None]


def test_amounts(spark):
    given = ["25 bps and 25.0 BP, 3.50% or 0.5%", "降25个基点、25 基点", "1.25 Basis  Points", "25bpsx 7 %", None]
    assert column(spark, given, lambda v: F.array_join(titles.amounts(v), ","), raw=True) == ["0.5pct,25bp,3.5pct", "25bp", "1.25bp", "7pct", None]


SCHEMA = (
    "item_id bigint, title string, published_at timestamp, external_id string, canonical_url string, cluster_key string, person string, assets array<string>, tier string, evidence string, impact string, observed_at timestamp"
)


def items(n, seed):
    rng, out = random.Random(seed), []
    heads = ["Fed cuts rates by 25 basis points", "美联储降息25个基点", "Fed hikes rates by 25 basis points", "OpenAI releases GPT-6", "OpenAI launches GPT-6", "Markets calm", "Markets calm!", "Other news", "", "Fed may cut rates"]
    for k in range(n):
        at = rng.choice([None, NOON + dt.timedelta(hours=rng.choice([0, 1, 2, 30]))])
        pick = lambda stem, many: rng.choice([None, "", *(f"{stem}{x}" for x in range(many))])
        out.append((
            k + 1, rng.choice(heads), at, pick("doc:", 8), pick("https://e.com/", 9), pick("c-", 3), rng.choice(["powell", None]), rng.choice([None, [], ["US:A"]]), rng.choice(["official", "first_party", "reporting", "discovery", None]),
            rng.choice(["official_body", "title", None]), rng.choice(["critical", "high", "medium", "low", "unknown", None]), rng.choice([None, NOON + dt.timedelta(hours=rng.randint(0, 90))]),
        ))
    return out


def plain_clusters(rows):
    """One record after the other joined to those with a key of theirs; then clusters by the claim of their representative."""
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    last = {}
    for r in rows:
        parent[r["item_id"]] = r["item_id"]
        for kind in ("stable", "located", "model"):
            if r[kind]:
                before = last.get((kind, r[kind]))
                if before is not None and root(before) != root(r["item_id"]):
                    parent[root(before)] = root(r["item_id"])
                last[kind, r[kind]] = r["item_id"]
    groups = {}
    for r in rows:
        groups.setdefault(root(r["item_id"]), []).append({**r, "members": 1})
    ranks = lambda r: (clusters.TIERS.get(r["tier"], 0), clusters.EVIDENCE.get(r["evidence"], 0), clusters.IMPACTS.get(r["impact"], 0))
    ms = lambda t: t.timestamp() if t else -1e18

    def merged(group, revisions):
        repeated = lambda c: (v := [r[c] for r in group if r.get(c)]) and len(v) != len(set(v))
        revising = revisions and (repeated("stable") or repeated("located"))
        primary = lambda r: (-ranks(r)[0], -ranks(r)[2], -ms(r["published_at"]), r["canonical_url"] or "", r["item_id"])
        revised = lambda r: (-ranks(r)[0], -ranks(r)[1], -ms(r["published_at"]), -ms(r["observed_at"]), -ranks(r)[2], r["item_id"])
        base = dict(min(group, key=revised if revising else primary))
        peers = [r for r in group if ranks(r)[:2] == ranks(base)[:2]]
        strength = lambda some: max(ranks(r)[2] for r in some)
        level = ranks(base)[2] if revising and (base["impact"] or "unknown") != "unknown" else strength(peers if revising else group)
        seen = [r["observed_at"] for r in peers if r["observed_at"]]
        count = max(len({r["canonical_url"] for r in group if r["canonical_url"] is not None}), len(group), max(r.get("count", 0) for r in group))
        return {**base, "level": level, "observed_at": max(seen) if seen else None, "members": sum(r["members"] for r in group), "count": count}

    exact = [merged(g, True) for g in groups.values()]
    final = {}
    for k, r in enumerate(exact):
        names = {v: n for n, v in clusters.IMPACTS.items() if n not in ("unknown",)}
        r["impact"] = names[r["level"]] if r["level"] or (r["impact"] not in (None, "unknown")) else r["impact"]
        final.setdefault(tuple(r["claim"]) if r["claim"] else k, []).append(r)
    return [merged(g, False) for g in final.values()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_against_greedy(spark, seed):
    df = spark.createDataFrame(items(140, seed), SCHEMA).repartition(3)
    rows = sorted((r.asDict() for r in clusters.keyed(df).collect()), key=lambda r: r["item_id"])
    want = plain_clusters(rows)
    got = clusters.cluster(df).collect()
    mine = sorted((r["base_id"], r["members"], clusters.IMPACTS.get(r["impact"], 0), r["source_count"], str(r["observed_at"])) for r in got)
    assert mine == sorted((r["item_id"], r["members"], r["level"], r["count"], str(r["observed_at"])) for r in want)
    assert sum(r["members"] for r in got) == len(rows) and all(r["story_key"].startswith("story_") and len(r["story_key"]) == 30 for r in got)


def test_story_keys(spark):
    rows = [
        (1, "Markets calm", NOON, "doc:9", "https://e.com/z", None, None, None, None, None, None, None), (2, "Markets calm", NOON, "doc:9", "https://e.com/a", None, None, None, None, None, None, None),
        (3, "Other", None, None, None, None, None, None, None, None, None, None), (4, "x", None, "", "https://e.com/q", None, None, None, None, None, None, None),
    ]
    got = {r["base_id"]: r["story_key"] for r in clusters.cluster(spark.createDataFrame(rows, SCHEMA)).collect()}
    name = lambda *parts: "story_" + hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:24]
    assert got == {1: name("stable", "doc:9", "2026-07-01", "title", "marketscalm"), 3: name("title", "other"), 4: name("url", "https://e.com/q", "", "title", "x")}
