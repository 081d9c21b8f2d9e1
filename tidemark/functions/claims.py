"""Claims of headlines: what a title says that others may say too, or nothing where that isn't sure.

A claim has a day, an action, who acts and details. It is only read where the whole title is one of a few wordings of a fact (claim_values.FACTS): a title with a
modal, a plan, a time before, several actions or a denial has none, so unlike reports are never taken for one. All but `plain` take a plain title that is
a column of its own (batches of Python make some of them, which no expression may hold within itself).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import claim_values as V
from . import titles
from .binding import once
from .forms import nfkc

#: Letters of a title that are read, and the zone that its day is of.
LENGTH, ZONE = 240, "Asia/Shanghai"
RATES, HOLDINGS = ("rate_cut", "rate_hike", "rate_cut_denial", "rate_hike_denial"), ("holding_increase", "holding_decrease", "holding_increase_denial", "holding_decrease_denial")


def says(text: Column, pattern: str) -> Column:
    return text.rlike("(?iU)" + pattern)


def plain(title: Column) -> Column:
    """White space single, the first LENGTH letters, their NFKC form in lower case."""
    flat = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " "))
    return F.lower(nfkc(F.left(flat, F.lit(LENGTH))))


def briefing_title(text: Column) -> Column:
    """A plain title by its letters, digits and Chinese characters: synonyms made one, the publisher at its end dropped."""
    for pattern, to in V.SYNONYMS:
        text = F.regexp_replace(text, "(?iU)" + pattern, to)
    return F.regexp_replace(F.regexp_replace(text, V.PUBLISHER, ""), r"[^0-9a-z㐀-鿿]+", "")


def action(text: Column) -> Column:
    """What a plain title says is done: a denial before the deed it denies, the first of the deeds; null for none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed([a for a in V.ACTIONS if a[0] != "rate_hold"]):
        out = F.when(says(text, pattern), name).otherwise(out)
    denied = F.lit(None).cast("string")
    for name, pattern in reversed(V.DENIED):
        denied = F.when(says(text, pattern), name).otherwise(denied)
    out = F.coalesce(F.when(says(text, V.NEGATION), denied), out)
    return F.when(says(text, V.WAR) & says(text, V.WAR_DENIED), "war_denial").otherwise(out)


def _sure(text: Column, deed: Column) -> Column:
    """Whether the whole title is a wording of the deed as a fact."""
    several = F.size(F.array_compact(F.array(*[F.when(says(text, p), 1) for _, p in V.ACTIONS])))
    open_ = says(text, V.MODAL) | says(text, V.INFINITIVE) | (several > 1) | ((several > 0) & says(text, V.HISTORICAL))
    told = F.lit(False)
    for name, wordings in V.FACTS.items():
        told = told | ((deed == name) & says(text, "|".join(f"(?:{w})" for w in wordings)))
    return ~open_ & told


def _who(text: Column, deed: Column, assets: Column, person: Column) -> Column:
    """Who acts, as far as the deed needs; null if that isn't said."""
    named = F.array_compact(F.array(*[F.when(says(text, p), F.lit(name)) for name, p in V.ENTITIES]))
    only = lambda *names: F.array_intersect(named, F.array(*map(F.lit, names)))
    owned = F.transform(F.filter(F.coalesce(assets, F.array().cast("array<string>")), lambda a: F.trim(a) != ""), lambda a: F.concat(F.lit("asset:"), F.upper(F.trim(a))))
    banks, powers, all_ = only("fed", "pboc"), only("vance", "trump", "iran", "israel"), F.array_union(named, owned)
    holders = F.array_union(all_, F.when(F.coalesce(person, F.lit("")) != "", F.array(F.concat(F.lit("kol:"), F.lower(person)))).otherwise(F.array().cast("array<string>")))
    return (
        F.when(deed.isin(*RATES), F.when(F.size(banks) > 0, banks)).when(deed == "war_denial", F.when(F.array_contains(named, "vance") & F.array_contains(named, "iran"), powers))
        .when(deed.isin(*HOLDINGS), F.when(F.size(holders) > 1, holders)).otherwise(F.when(F.size(all_) > 0, all_))
    )


def _details(text: Column, deed: Column) -> Column:
    """Amounts and objects of the deed; null if a product isn't named."""
    amounts = titles.amounts(text)
    kind = F.when(says(text, V.REASONING), F.array(F.lit("reasoning_model"))).when(says(text, V.MODEL), F.array(F.lit("model"))).otherwise(F.array().cast("array<string>"))
    names = F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + V.PRODUCT), 0), lambda n: F.replace(n, F.lit(" "), F.lit("-")))
    things = F.concat(amounts, kind, names)
    return (
        F.when(deed.isin(*RATES), F.concat(amounts, F.array(F.lit("policy_rate")))).when(deed == "war_denial", F.concat(amounts, F.array(F.lit("iran_conflict"))))
        .when(deed.isin(*HOLDINGS), amounts).otherwise(F.when(F.size(things) > 0, things))
    )


def day(published: Column) -> Column:
    """The day of a verified publication where the desk is."""
    return F.date_format(F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(published.cast("timestamp"), F.current_timezone()), ZONE)), "yyyy-MM-dd")


def signature(text: Column, published: Column, assets: Column, person: Column) -> Column:
    """[day, action, entities, details] of a plain title with a verified publication, sorted and joined by commas; null without a sure claim."""
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")

    def told(deed: Column) -> Column:
        who, details = _who(text, deed, assets, person), _details(text, deed)
        claim = F.array(day(published), deed, joined(who), joined(details))
        return F.when(published.isNotNull() & deed.isNotNull() & _sure(text, deed) & who.isNotNull() & details.isNotNull(), claim)

    return once(action(text), told)
