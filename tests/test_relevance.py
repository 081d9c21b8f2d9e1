"""Relevance of sightings: literal cases, and whole random texts against the same rules in plain Python."""

import random
import re
import unicodedata

import pytest

from tidemark.functions import relevance_values as V
from tidemark.functions import titles
from tidemark.operators import relevance

SCHEMA = "n int, title string, snippet string, source string, url string, kol_key string, kol_name string, kol_name_cn string, handle string"
PEOPLE = {
    "zuckerberg": ("Mark Zuckerberg", "扎克伯格"), "musk": ("Elon Musk", "马斯克"), "trump": ("Donald Trump", "特朗普"), "powell": ("Jerome Powell", "鲍威尔"), "justinsun": ("Justin Sun", "孙宇晨"),
    "serenity": ("Serenity", "Serenity"), "huangrenxun": ("Jensen Huang", "黄仁勋"), "buffett": ("Warren Buffett", "巴菲特"), "burry": ("Michael Burry", "迈克尔·伯里"), "altman": ("Sam Altman", "Sam Altman"),
}


def row(title, key="zuckerberg", snippet="", source="Bing News", url="https://example.com/story", handle=None):
    return (title, snippet, source, url, key, *PEOPLE.get(key, (None, None)), handle)


def assessed(spark, rows, **options):
    found = relevance.assess(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA).repartition(3), **options).collect()
    return [r["relevance"] for r in sorted(found, key=lambda r: r["n"])]


X_MUSK, TRUTH = ("X @elonmusk", "https://x.com/elonmusk/status/123"), ("Truth Social @realDonaldTrump", "https://truthsocial.com/@realDonaldTrump/123")
#: (row, eligible, finance relevant, reason, impact, alias, basis)
CASES = [
    (row("Man hospitalised after train strikes tractor in Tullamore crash", snippet="A local road was closed after the collision."), False, False, "entity_not_found", "low", None, "missing"),
    (row("Elon Musk unhurt after car crash on highway", "musk"), True, False, "non_finance", "low", "Elon Musk", "person_mention"),
    (row("Zuckerberg warns a stock market crash is possible"), True, True, "person_mention_finance", "high", "Zuckerberg", "person_mention"),
    (row("Meta shares crash after guidance cut"), True, True, "affiliated_company_finance", "high", "Meta", "company_mention"),
    (row("Zuckerberg says Meta will raise AI capex next year"), True, True, "person_mention_finance", "medium", "Zuckerberg", "person_mention"),
    (row("Zuckerberg comments on the latest culture war"), True, False, "non_finance", "low", "Zuckerberg", "person_mention"),
    (row("New meta-analysis reviews sleep patterns in adults"), False, False, "entity_not_found", "low", None, "missing"),
    (row("Meta hosts its annual holiday party"), True, False, "non_finance", "low", "Meta", "company_mention"),
    (row("黄仁勋参观当地菜市场", "huangrenxun"), True, False, "non_finance", "low", "黄仁勋", "person_mention"),
    (row("鲍威尔乘坐经济舱", "powell"), True, False, "non_finance", "low", "鲍威尔", "person_mention"),
    (row("Warren Buffett stocks pantry shelves for charity", "buffett"), True, False, "non_finance", "low", "Warren Buffett", "person_mention"),
    (row("STOCKS TRUMP BONDS AFTER RATE CUT", "trump"), False, True, "entity_not_found", "low", None, "missing"),
    (row("Why Stocks Could Trump Bonds Again", "trump"), False, True, "entity_not_found", "low", None, "missing"),
    (row("Stocks trump bonds, as a study of many years has shown; Trump disagrees", "trump"), True, True, "person_mention_finance", "low", "Trump", "person_mention"),
    (row("Powell Industries stock rises after earnings", "powell"), False, True, "entity_not_found", "low", None, "missing"),
    (row("Powell Industries rises; Powell speaks", "powell"), True, False, "non_finance", "low", "Powell", "person_mention"),
    (row("Powell holds rates steady", "powell"), True, True, "person_mention_finance", "high", "Powell", "person_mention"),
    (row("Michael Burry 做空特斯拉", "burry"), True, True, "person_mention_finance", "medium", "Michael Burry", "person_mention"),
    (row("OpenAI融资", "altman"), True, True, "affiliated_company_finance", "medium", "OpenAI", "company_mention"),
    (row("Launching Grok 5 next week", "musk", source=X_MUSK[0], url=X_MUSK[1]), True, True, "direct_source_finance", "medium", "@elonmusk", "direct_source"),
    (row("AI investment demand remains strong", "musk", source="X @notelonmusk", url="https://x.com/notelonmusk/status/1"), False, True, "entity_not_found", "low", None, "missing"),
    (row("AI investment demand remains strong", "nobody", source="X @Some_One", url="https://x.com/some_one/status/1", handle="@some_one"), True, True, "direct_source_finance", "low", "@some_one", "direct_source"),
    (row("WAR", "trump", source=TRUTH[0], url=TRUTH[1]), True, True, "direct_source_finance", "high", "@realdonaldtrump", "direct_source"),
    (row("WAR", source=TRUTH[0], url=TRUTH[1]), False, False, "entity_not_found", "low", None, "missing"),
    (row("RT: https://x.com/a", "trump", source=TRUTH[0], url=TRUTH[1]), False, False, "insubstantial_content", "low", "@realdonaldtrump", "direct_source"),
    (row("Ｔｅｓｌａ cuts prices", "musk"), True, True, "affiliated_company_finance", "medium", "Tesla", "company_mention"),
    (row("Elon\n  Musk buys a ﬁeld", "musk"), True, False, "non_finance", "low", "Elon Musk", "person_mention"),
    (row(None, None), False, False, "insubstantial_content", "low", None, "missing"),
]


def test_literal_cases(spark):
    for (case, *want), got in zip(CASES, assessed(spark, [c[0] for c in CASES]), strict=True):
        assert [got[c] for c in ("eligible", "finance_relevant", "reason", "rule_impact", "matched_alias", "attribution_basis")] == want, case[0]
        assert got["intelligence_eligible"] == (got["eligible"] and got["finance_relevant"]) and got["entity_match"] == (got["matched_alias"] is not None)


def test_without_entity(spark):
    got = assessed(spark, [row("Tariffs on steel")], require_entity=False)[0]
    assert got["eligible"] and not got["entity_match"] and got["reason"] == "person_mention_finance"


def test_no_pattern_a_name(spark, capsys):
    relevance.assess(spark.createDataFrame([(0, *row("a"))], SCHEMA)).explain("extended")
    plan = capsys.readouterr().out
    assert "Zuckerberg" not in plan.split("== Physical Plan ==")[1] and plan.count("BroadcastHashJoin") >= 1


def test_substance(spark):
    texts = ["涨@bob", "涨跌", "RT @a https://b.com", "VIA bob.org", "$T", "a b", "_ _ _", "RETRUTH — x.io/a ok", "é@bob a", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r[1] for r in df.select("k", titles.substantive(df.t)).orderBy("k").collect()]
    link, has = re.compile(titles.LINK, re.I), []
    for t in texts:
        t = re.sub(titles.ATTRIBUTION, "", re.sub(titles.REPOST, "", t or "", flags=re.I), flags=re.I)
        t = re.sub(titles.MENTION, " ", link.sub(" ", t))
        has.append(bool(re.search(titles.CASHTAG, t)) or len(re.sub(r"\W|_", "", t)) >= 3 or len(re.findall("[㐀-鿿]", t)) >= 2)
    assert got == has


# The same rules, read one text at a time.
def names_in(text, names, guard):
    for name in sorted(names, key=len, reverse=True):
        flat = unicodedata.normalize("NFKC", name)
        pattern = r"\s+".join(map(re.escape, flat.split(" ")))
        if re.fullmatch(r"[A-Za-z0-9@$.'’&\- ]+", flat):
            pattern = (r"(?<![A-Za-z0-9_])" if flat[0].isalnum() else "") + pattern + (r"(?![A-Za-z0-9_])" if flat[-1].isalnum() else "")
        if any(guard(name.lower(), m) for m in re.finditer(pattern, text, re.I)):
            return name
    return None


def plain(title, snippet, source, url, key, name, name_cn, handle):
    text = unicodedata.normalize("NFKC", f"{title or ''} {snippet or ''}").strip()
    says = lambda p, t=text: re.search(p, t, re.I) is not None

    def person(name, m):
        if key == "trump" and name == "trump":
            return m[0] in ("Trump", "TRUMP") and not says(V.TRUMP_VERB, text[max(0, m.start() - 32) : m.end() + 32])
        return not (key == "powell" and name == "powell" and re.match(V.POWELL_COMPANY, text[m.end() :], re.I))

    people = list(V.PERSONS.get(key, ()))
    people += [n for n in (name, name_cn) if n and n.lower() not in [p.lower() for p in people]]
    alias, basis = names_in(text, people, person), "person_mention"
    if alias is None:
        meta = lambda name, m: name != "meta" or says(V.META_COMPANY)
        alias, basis = names_in(text, V.COMPANIES.get(key, ()), meta), "company_mention"
    if alias is None:
        basis = "missing"
    figures = says(V.BUSINESS_METRIC) or says(V.CAPITAL_ALLOCATION) or says(V.CORPORATE_EVENT)
    act, trade, thing = says(V.CORPORATE_ACTION), says(V.TRADE_ACTION), says(V.BUSINESS_OBJECT)
    by = {"company_mention": act or (trade and thing), "missing": False, "person_mention": (act and thing) or (trade and (says(V.POSITION_OBJECT) or (key in V.TRADERS and thing)))}[basis]
    business = not says(V.NON_BUSINESS) and (figures or by)
    war = says(V.WAR) and says(V.GEO_CONTEXT) and not says(V.NON_GEO_WAR)
    sense = re.sub(V.AMBIGUOUS_FINANCE, " ", text, flags=re.I)
    finance = bool(text) and not (says(V.PHYSICAL_CRASH) and not says(V.ACCIDENT_CONSEQUENCE)) and (
        re.search(V.TICKER, sense) is not None or any(says(p, sense) for p in (V.FINANCE, V.FINANCE_CONTEXT, V.MARKET_SHOCK, V.BUBBLE_CRISIS)) or (not says(V.NON_BUSINESS) and says(V.RATE_HOLD)) or business or war
    )
    high = (not says(V.PHYSICAL_CRASH) and says(V.MARKET_SHOCK)) or any(says(p) for p in (V.BUBBLE_CRISIS, V.RATE_DECISION, V.RATE_HOLD, V.TARIFF_ACTION, V.SYSTEMIC)) or war
    impact = "low" if not finance else "high" if high else "medium" if says(V.MEDIUM) or business else "low"
    return alias, basis, finance, impact


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    rng = random.Random(seed)
    words = (
        "Trump trump TRUMP stocks Stocks could may bonds Powell Industries Meta meta -analysis Tesla特斯拉 特斯拉 马斯克 Elon Musk buys sold Apple Watch stake war 价格战 战争 Iran culture crash car market "
        "shares plunge bubble AI 金融 危机 Fed cuts rates 降息 基点 hold steady unchanged tariffs 25% 关税 加征 recession 经济舱 economy class launch launches chip 芯片 product museum $NVDA $nvda x$TSLA ETF IPO "
        "revenue ﬁnance Ｆｅｄ é İ _AI_ AI危机 funding round raises capital capex 提高 资本开支 deliveries rose 出货 增长 oil painting prices layoffs , . ； \n"
    ).split(" ")
    rows = [row(" ".join(rng.choices(words, k=rng.randint(1, 9))), rng.choice([*PEOPLE, "nobody"]), " ".join(rng.choices(words, k=rng.randint(0, 6)))) for _ in range(1500)]
    for r, got in zip(rows, assessed(spark, rows), strict=True):
        want = plain(*r)
        assert (got["matched_alias"], got["attribution_basis"], got["finance_relevant"], got["rule_impact"]) == want, r
