"""What texts are about, policy notices and openings by literal cases; the scores against plain Python."""

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import policy, topics
from tidemark.functions import topic_values as V
from tidemark.sources import payloads

CASES = [
    ("Why Rust language changes API design", "A practical guide and methodology for library authors.", "software_dev", ["rust", "methodology"]),
    ("Actively exploited sandbox RCE in all Chromium versions", "The security advisory assigns a CVE to the browser vulnerability.", "security_privacy", ["browser", "vulnerability"]),
    ("ChatGPT, Claude and Grok hit by simultaneous outages", "The service disruption affected three AI services; no shared root cause is confirmed.", "cloud_infra", ["ai_service", "incident_review"]),
    ("a walk in the park", None, "general_interest", []), (None, None, "general_interest", []),
]


def test_literal_cases(spark):
    df = spark.createDataFrame([(k, t, e) for k, (t, e, *_) in enumerate(CASES)], "k int, title string, evidence string")
    got = [(r["category"], r["tags"]) for r in topics.assigned(df).orderBy("k").collect()]
    assert got == [(c, tags) for *_, c, tags in CASES]


def plain(title, evidence):
    def scores(rules):
        out = {}
        for key, signs in rules.items():
            n = sum((a if title and re.search(p, title, 0 if exact else re.I) else 0) + (b if evidence and re.search(p, evidence, 0 if exact else re.I) else 0) for p, a, b, exact in signs)
            if n:
                out[key] = n
        return out

    found, tags = scores(V.CATEGORY_RULES), scores(V.TAG_RULES)
    category = max(V.CATEGORIES, key=lambda k: (found.get(k, 0), -V.CATEGORIES.index(k))) if found else "general_interest"
    ranked = lambda names: sorted((k for k in names if k in tags), key=lambda k: (-tags[k], names.index(k)))
    one = ranked(V.SUBJECTS)[:1] + ranked(V.LENSES)[:1]
    return category, (one + [k for k in ranked(V.SUBJECTS + V.LENSES) if k not in one])[:2]


def test_against_plain(spark):
    rng = random.Random(6)
    words = [w for rules in (V.CATEGORY_RULES, V.TAG_RULES) for signs in rules.values() for p, *_ in signs for w in re.split(r"[|()?:\\^$\[\]{}.*+]+", p) if len(w) > 1]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 3))), " ".join(rng.choices(words + ["é", "and", "中"], k=rng.randint(0, 8)))) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, title string, evidence string").repartition(4)
    got = {r["k"]: (r["category"], r["tags"]) for r in topics.assigned(df).collect()}
    squeeze = lambda t: " ".join(t.split())
    for k, t, e in rows:
        assert got[k] == plain(squeeze(t), squeeze(e)), (t, e)


def test_policy(spark):
    def column(values, of):
        df = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], "k int, a string, b string, c string, d string")
        return [r[0] for r in df.orderBy("k").select(of(*map(F.col, "abcd"))).collect()]

    pad = lambda *t: (*t, None, None, None, None)[:4]
    texts = [pad("FOMC holds"), pad("央行宣布降准"), pad("Speech on the Outlook"), pad("Calm"), pad(None)]
    assert column(texts, lambda a, *_: policy.severity(a)) == ["high", "high", "medium", "low", "low"]
    touched = column([pad("Tariff and inflation; sanction"), pad("corporate banking"), pad("nothing")], lambda a, *_: policy.touched(a))
    assert [(r["tickers"], r["sectors"]) for r in touched] == [(["TIP", "GLD", "SOXL", "FXI"], ["通胀受益板块", "半导体", "跨境贸易链"]), (["TLT", "SPY", "KRE"], ["美债", "利率敏感板块", "区域银行", "信用市场"]), ([], [])]
    notices = [
        (" FED_Speech ", "x", "y", "z"), ("odd", "t", "中国人民银行", "https://www.pbc.gov.cn/a"), (None, "t", "中国人民银行", "https://e.com"), (None, "Remarks", "Board", "https://f.gov/newsevents/speech/a"), (None, "FOMC Minutes", "wire", "u"),
        (None, "FOMC 声明", "wire", "u"), (None, "Press", "Federal Reserve Board", "u"), (None, None, None, None),
    ]
    want = ["fed_speech", "pboc_announcement", "policy_update", "fed_speech", "fomc_minutes", "fomc_statement", "fed_press_release", "policy_update"]
    assert column(notices, policy.category) == want


def test_openings(spark):
    cases = [((36.0, 0.5, 1.0, 0.0, 7.0), ["panic_buying high"]), ((28.5, 0.0, 1.0, -2.5, 7.21), ["panic_buying medium", "curve_normalization medium", "dip_buying medium", "currency_tailwind medium"]), ((28.0, 0.3, 1.0, -2.0, 7.2), []), ((None, None, None, None, None), [])]
    df = spark.createDataFrame([(k, *v) for k, (v, _) in enumerate(cases)], "k int, v double, c double, g double, h double, r double")
    got = [r[0] for r in df.orderBy("k").select(F.transform(policy.opportunities(*map(F.col, "vcghr")), lambda o: F.concat_ws(" ", o["kind"], o["confidence"]))).collect()]
    assert got == [want for _, want in cases]


def test_yield_curves(spark):
    feed = "<feed><entry><d:NEW_DATE m:type='d'>2026-07-01T00:00:00</d:NEW_DATE><d:BC_2YEAR m:x='1'>3.9104</d:BC_2YEAR><d:BC_10YEAR>4.2</d:BC_10YEAR></entry>\n<entry><d:NEW_DATE>2026-07-02T00:00:00</d:NEW_DATE><d:BC_2YEAR>3.8556</d:BC_2YEAR><d:BC_10YEAR></d:BC_10YEAR></entry></feed>"
    rows = [("a", feed), ("b", feed.replace("BC_2", "BC_30") + feed), ("c", "<html>"), ("d", None)]
    got = {r["source"]: (r["as_of"], *(r["yields"][t] for t in ("2Y", "10Y", "30Y")), r["status"]) for r in payloads.treasury_yields(spark.createDataFrame(rows, "source string, body string")).collect()}
    assert got == {"a": ("2026-07-02", 3.856, 4.2, None, "partial"), "b": ("2026-07-02", 3.856, 4.2, 3.856, "ready"), "c": (None, None, None, None, "unavailable"), "d": (None, None, None, None, "unavailable")}
