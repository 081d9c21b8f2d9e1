"""Relevance of sightings: whom a text is about, whether it concerns markets, and how much it may move them.

All rules work in columns on the text's NFKC form, bound once. Names are looked up without a pattern a name: the words of Latin letters and digits in a
text are fenced by a mark, as those of a name are, so that a name stands in the text by itself exactly where its fenced form is part of the fenced text.
The names come as a dimension by person, whose size is that of a directory, longest name first, persons before companies; names in the row are put among them.
Texts that nobody is named in end there; the other patterns are asked of the text as a whole.

Defined cases: null titles and snippets are empty; a null person has no names of its own but those in the row; a null or unreadable url is nobody's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import relevance_values as V
from ..functions import states, titles
from ..functions.binding import once
from ..functions.forms import nfkc

VERSION = "event-relevance-v2"
#: Letters on each side of a name that its guard looks at.
WINDOW = 32
_FENCE = "\u0001"
_FOLD = "(?iU)"


def _fenced(text: Column) -> Column:
    """Lower-cased, white space single, words of Latin letters, digits and _ between fences."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), "([a-z0-9_]+)", _FENCE + "$1" + _FENCE)


def _name(text: Column, rank: Column) -> Column:
    """A name as it is searched for: names with other letters than Latin ones stand anywhere."""
    latin = text.rlike(r"^[A-Za-z0-9@$.'’&\- ]+$")
    whole = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    return F.struct((-F.length(text)).alias("size"), rank.alias("rank"), text.alias("name"), F.when(latin, _fenced(text)).otherwise(whole).alias("sought"), latin.alias("latin"))


def directory(spark) -> DataFrame:
    """(key, people, companies): the fixed names by person, in order of search."""
    rows = [(key, list(names), list(V.COMPANIES.get(key, ()))) for key, names in V.PERSONS.items()]
    names = lambda c: F.array_sort(F.transform(c, lambda x, i: _name(x, i)))
    return spark.createDataFrame(rows, "key string, people array<string>, companies array<string>").select("key", names("people").alias("people"), names("companies").alias("companies"))


def _says(text: Column, pattern: str) -> Column:
    return text.rlike(_FOLD + pattern)


def _stands(text: Column, fenced: Column, name: Column) -> Column:
    return F.when(name["latin"], F.contains(fenced, name["sought"])).otherwise(F.contains(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), name["sought"]))


def _trump(text: Column) -> Column:
    """Whether "Trump" stands for the person somewhere: with a capital, and not as the verb of a comparison."""

    def found(parts: Column) -> Column:
        # A part ends where an occurrence, five letters long, begins.
        ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda n, p: n + F.length(p)) + 5 * (k - 1))

        def person(at: Column) -> Column:
            start = F.greatest(at - WINDOW, F.lit(0))
            around = F.substr(text, start + 1, at + 5 + WINDOW - start)
            return F.substr(text, at + 1, F.lit(5)).isin("Trump", "TRUMP") & ~_says(around, V.TRUMP_VERB)

        return F.when(F.size(parts) > 1, F.exists(ends, person)).otherwise(False)

    return once(F.split(text, "(?i)(?<![A-Za-z0-9_])trump(?![A-Za-z0-9_])"), found)


def _first(text: Column, fenced: Column, key: Column, names: Column, people: bool) -> Column:
    """The first name in order that stands in the text, null if none does."""

    def stands(name: Column) -> Column:
        here = _stands(text, fenced, name)
        lower = F.lower(name["name"])
        if not people:
            return here & ((lower != "meta") | text.rlike("(?i)" + V.META_COMPANY))
        trump = F.when((key == "trump") & (lower == "trump"), _trump(text)).otherwise(True)
        powell = F.when((key == "powell") & (lower == "powell"), text.rlike(f"(?i)(?<![A-Za-z0-9_])powell(?![A-Za-z0-9_])(?!{V.POWELL_COMPANY})")).otherwise(True)
        return here & trump & powell

    return F.get(F.filter(names, stands), 0)["name"]


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^:/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def direct(source: Column, url: Column) -> Column:
    """Whether source and url together are a first-party post."""
    label, host, path = F.trim(F.coalesce(source, F.lit(""))), _host(F.trim(F.coalesce(url, F.lit("")))), F.lower(_path(F.trim(F.coalesce(url, F.lit("")))))
    mirrored = host.isin("truthsocial.com", "www.truthsocial.com") & F.contains(path, F.lit("/@"))
    posted = host.isin("x.com", "www.x.com", "twitter.com", "www.twitter.com") & F.contains(path, F.lit("/status/"))
    return _says(label, V.DIRECT_SOURCE) & F.when(F.lower(label).startswith("truth social @"), mirrored).otherwise(posted)


def owned_handle(source: Column, url: Column, key: Column, handle: Column) -> Column:
    """The account of a verified first-party post: the source's, which the url must name too, among the person's own; else null."""
    said = F.lower(F.regexp_extract(F.coalesce(source, F.lit("")), "@([A-Za-z0-9_]{1,64})", 1))
    named = F.lower(F.regexp_extract(_path(F.coalesce(url, F.lit(""))), "/@?([A-Za-z0-9_]{1,64})/", 1))
    configured = F.lower(F.regexp_replace(F.trim(F.coalesce(handle, F.lit(""))), "^@+", ""))
    own = F.lit(False)
    for person, accounts in V.HANDLES.items():
        own = own | ((key == person) & said.isin(*accounts))
    return F.when(direct(source, url) & (said != "") & (own | (said == configured)) & (said == named), said)


def _business(text: Column, basis: Column, key: Column) -> Column:
    """Whether a text tells an action or a figure of business, not only a word of it."""
    corporate, trade, thing = _says(text, V.CORPORATE_ACTION), _says(text, V.TRADE_ACTION), _says(text, V.BUSINESS_OBJECT)
    by_basis = (
        F.when(basis == "company_mention", corporate | (trade & thing)).when(basis == "direct_source", (corporate | trade) & thing)
        .when(basis == "person_mention", (corporate & thing) | (trade & (_says(text, V.POSITION_OBJECT) | (key.isin(*V.TRADERS) & thing)))).otherwise(False)
    )
    figures = _says(text, V.BUSINESS_METRIC) | _says(text, V.CAPITAL_ALLOCATION) | _says(text, V.CORPORATE_EVENT)
    return ~_says(text, V.NON_BUSINESS) & (figures | by_basis)


def _war(text: Column, owned: Column, key: Column) -> Column:
    """A war between states: in its context, or in a word of a policy figure's own post."""
    return _says(text, V.WAR) & ~_says(text, V.NON_GEO_WAR) & (_says(text, V.GEO_CONTEXT) | ((key == "trump") & owned))


def _finance(text: Column, business: Column, war: Column) -> Column:
    """Whether a text concerns assets, business, the economy or war."""
    sense = once(F.regexp_replace(text, _FOLD + V.AMBIGUOUS_FINANCE, " "), lambda t: t.rlike("(?U)" + V.TICKER) | _says(t, V.FINANCE) | _says(t, V.FINANCE_CONTEXT) | _says(t, V.MARKET_SHOCK) | _says(t, V.BUBBLE_CRISIS))
    accident = _says(text, V.PHYSICAL_CRASH) & ~_says(text, V.ACCIDENT_CONSEQUENCE)
    held = ~_says(text, V.NON_BUSINESS) & _says(text, V.RATE_HOLD)
    return (text != "") & ~accident & (sense | held | business | war)


def _high(text: Column, war: Column) -> Column:
    shock = ~_says(text, V.PHYSICAL_CRASH) & _says(text, V.MARKET_SHOCK)
    return shock | _says(text, V.BUBBLE_CRISIS) | _says(text, V.RATE_DECISION) | _says(text, V.RATE_HOLD) | _says(text, V.TARIFF_ACTION) | _says(text, V.SYSTEMIC) | war


def assess(sightings: DataFrame, require_entity: bool = True) -> DataFrame:
    """sightings(title, snippet, source, url, kol_key, kol_name, kol_name_cn, handle, ...) with relevance, a struct of nine.

    eligible: words of its own, and attributed to the person or a company of theirs; intelligence_eligible: and it concerns markets; reason: the first
    that fails, or what speaks for it; rule_impact: high, medium or low by the text alone; attribution_basis: direct_source, person_mention, company_mention or missing.
    """
    spark = sightings.sparkSession
    raw = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    key = F.lower(F.trim(F.coalesce("kol_key", F.lit(""))))
    text = sightings.withColumn("_text", F.regexp_replace(nfkc(raw), r"(?U)^\s+|\s+$", "")).withColumn("_key", key)
    # The directory has a row a person.
    known = F.broadcast(directory(spark).select(F.col("key").alias("_of"), "people", "companies").withColumnsRenamed({"people": "_people", "companies": "_companies"}))
    rows = text.join(known, F.col("_key") == F.col("_of"), "left").drop("_of")
    own = F.filter(F.array(*[F.trim(F.coalesce(c, F.lit(""))) for c in ("kol_name", "kol_name_cn")]), lambda n: F.length(n) >= 2)
    none = F.array().cast(rows.schema["_people"].dataType)
    listed = F.coalesce("_people", none)
    new = F.filter(own, lambda n: ~F.exists(listed, lambda p: F.lower(p["name"]) == F.lower(n)))
    rows = rows.withColumn("_people", F.array_sort(F.concat(listed, F.transform(new, lambda n, i: _name(n, i + 1000))))).withColumn("_fenced", _fenced(F.col("_text")))
    t, k, url = F.col("_text"), F.col("_key"), F.col("url")
    rows = rows.withColumn("_person", _first(t, F.col("_fenced"), k, F.col("_people"), True)).withColumn("_handle", owned_handle(F.col("source"), url, k, F.col("handle")))
    rows = rows.withColumn("_company", F.when(F.col("_person").isNull(), _first(t, F.col("_fenced"), k, F.coalesce("_companies", none), False)))
    owned = F.col("_handle").isNotNull()
    alias = F.when(owned, F.concat(F.lit("@"), "_handle")).otherwise(F.coalesce("_person", "_company"))
    basis = F.when(owned, "direct_source").when(F.col("_person").isNotNull(), "person_mention").when(F.col("_company").isNotNull(), "company_mention").otherwise("missing")
    rows = rows.withColumn("_basis", basis).withColumn("_alias", alias)
    rows = rows.withColumn("_war", _war(t, owned, k)).withColumn("_business", _business(t, F.col("_basis"), k))
    rows = rows.withColumn("_finance", _finance(t, F.col("_business"), F.col("_war")))
    post = F.coalesce(F.nullif("snippet", F.lit("")), "title")
    content = (t != "") & states.content_eligible(F.col("source"), url, F.col("snippet"), F.col("title")) & (~owned | F.coalesce(titles.substantive(post), F.lit(False)))
    rows = rows.withColumn("_content", content)
    matched = F.col("_alias").isNotNull()
    impact = F.when(~F.col("_finance"), "low").when(_high(t, F.col("_war")), "high").when(_says(t, V.MEDIUM) | F.col("_business"), "medium").otherwise("low")
    lacks = F.lit(require_entity) & ~matched
    reason = (
        F.when(~F.col("_content"), "insubstantial_content").when(lacks, "entity_not_found").when(~F.col("_finance"), "non_finance")
        .when(F.col("_basis") == "direct_source", "direct_source_finance").when(F.col("_basis") == "company_mention", "affiliated_company_finance").otherwise("person_mention_finance")
    )
    eligible = F.col("_content") & ~lacks
    found = F.struct(
        eligible.alias("eligible"), (eligible & F.col("_finance")).alias("intelligence_eligible"), matched.alias("entity_match"), F.col("_finance").alias("finance_relevant"), reason.alias("reason"),
        impact.alias("rule_impact"), F.col("_alias").alias("matched_alias"), F.col("_basis").alias("attribution_basis"), F.lit(VERSION).alias("classifier_version"),
    )
    return rows.select(*sightings.columns, found.alias("relevance"))
