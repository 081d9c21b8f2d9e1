"""URLs as columns: canonical forms and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import once

#: Query keys that differ from fetch to fetch. Fixed values.
TRACKING = ("ref", "aid", "tid", "c", "mkt", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "from", "src")
#: Scheme, host, path and query of a url.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _kept_query(url: Column, ordered: bool, drop: Column) -> Column:
    """The query without the pairs that `drop`, a regular expression on their keys, names."""
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(drop))
    pairs = F.array_sort(pairs) if ordered else pairs
    return F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit(""))


def _decoded(text: Column) -> Column:
    """A part of a query as it is meant; one that can't be decoded as it stands."""
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unwrapped(url: Column) -> Column:
    """The address that a redirect's `url` (or else `u`) parameter holds, if it is one of http or https; else the url."""
    of = lambda key: F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*?&)??{key}=([^&#]+)", 1)
    held = once(F.struct(of("url").alias("url"), of("u").alias("u")), lambda h: _decoded(F.when(h["url"] != "", h["url"]).otherwise(h["u"])))
    return once(held, lambda inner: F.when(inner.rlike("^https?://"), inner).otherwise(url))


def canonical_url(url: Column) -> Column:
    """Redirects unwrapped up to three times, scheme and host lower-cased, pairs that track (their key in any case) or are blank dropped and the others
    encoded anew, no fragment, no slash at the end of a path, which is / if empty. A null url is the empty string."""
    once_more = lambda u: once(unwrapped(u), lambda v: once(unwrapped(v), unwrapped))
    return once(once(F.coalesce(F.trim(url), F.lit("")), once_more), _plain)


def _plain(u: Column) -> Column:
    part = lambda k: F.regexp_extract(u, _PARTS, k)
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda p: p.rlike("=.")), lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.transform(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING)), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"])))
    path = F.regexp_replace(part(3), "/+$", "")
    whole = F.concat(
        F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise(""), F.when(part(2) != "", F.concat(F.lit("//"), F.lower(part(2)))).otherwise(""),
        F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )
    return F.when(u == "", u).otherwise(whole)


def publisher_url(url: Column, hosts: list[str]) -> Column:
    """An https URL of one of the hosts or their subdomains, without `www.`, its query sorted and without utm_ pairs; else null."""
    u = F.trim(url)
    name = F.regexp_replace(host(u), r"^www\.", "")
    known = F.lit(False)
    for h in hosts:
        known = known | (name == h) | name.endswith("." + h)
    path = F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    whole = F.concat(F.lit("https://"), name, F.when(path == "", "/").otherwise(path), _kept_query(u, True, "^utm_"))
    return F.when(u.rlike("^(?i)https://") & known, whole)


def url_hash(url: Column) -> Column:
    return F.left(F.sha1(url), F.lit(16))
