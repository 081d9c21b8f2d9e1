"""Titles and short texts as columns: identity keys, amounts, substance."""

from __future__ import annotations

from functools import cache
from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import once
from .urls import canonical_url

#: Letters of a prefix key, least letters of a prefix duplicate, least letters of a repeated half.
PREFIX, LEAST, REPEAT = 12, 16, 6
#: Separators of CJK titles that Unicode counts among the letters.
LETTER_SEPARATORS = "丨"


@cache
def compatible() -> tuple[str, str]:
    """Characters whose NFKC form is another single character, and these: full and half widths, presentation forms, compatibility ideographs."""
    pairs = [(chr(c), normalize("NFKC", chr(c))) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000]
    moved = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in moved), "".join(b for _, b in moved)


def collapse_repeat(text: Column) -> Column:
    """A text whose second half starts over: cut before the first place, past the middle, from which the rest equals its start."""

    def cut(t: Column) -> Column:
        n = F.length(t)
        places = F.filter(F.sequence(F.greatest(F.floor(n / 2), F.lit(1)), F.greatest(n - REPEAT, F.lit(1))), lambda k: (k >= n / 2) & (n - k >= REPEAT) & t.startswith(F.substr(t, (k + 1).cast("int"))))
        # Few texts have their first letters again in the second half; the others are left at once.
        again = F.contains(F.substr(t, (F.floor(n / 2) + 1).cast("int")), F.left(t, F.lit(REPEAT)))
        return F.when((n >= 2 * REPEAT) & again, F.when(F.size(places) > 0, F.substr(t, F.lit(1), F.get(places, 0).cast("int"))).otherwise(t)).otherwise(t)

    return once(text, cut)


def normal_title(title: Column) -> Column:
    """Compatible forms made one (those of one character), letters and digits only, lower-cased, a self-repeat collapsed."""
    plain = F.lower(F.translate(F.coalesce(title, F.lit("")), *compatible()))
    return collapse_repeat(F.regexp_replace(plain, rf"[^\p{{L}}\p{{N}}]+|[{LETTER_SEPARATORS}]", ""))


def title_digest(plain: Column, url: Column) -> Column:
    """The identity of a normal title, of the canonical url where there is none."""
    return F.left(F.sha1(F.when(plain != "", plain).otherwise(F.coalesce(canonical_url(url), F.lit("")))), F.lit(20))


def dedup_key(title: Column, url: Column) -> Column:
    return once(normal_title(title), lambda plain: title_digest(plain, url))


def prefix_key(title: Column) -> Column:
    return once(normal_title(title), lambda plain: F.when(F.length(plain) >= PREFIX, F.left(F.sha1(F.left(plain, F.lit(PREFIX))), F.lit(16))))


def is_prefix_duplicate(a: Column, b: Column) -> Column:
    """Whether one of two normal titles, both long enough, starts with the other."""
    return (F.length(a) >= LEAST) & (F.length(b) >= LEAST) & (a.startswith(b) | b.startswith(a))


#: Amounts: points by any of their names, parts by their sign. Fixed values, read without regard to case.
POINTS = r"(?<!\d)(\d+(?:\.\d+)?)\s*(?:个?基点|bps?\b|basis\s+points?\b)"
PARTS = r"(?<!\d)(\d+(?:\.\d+)?)\s*%"


def amounts(text: Column) -> Column:
    """Sorted distinct amounts such as 25bp or 3.5pct, numbers without zeros at their ends."""
    short = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^0+(?=[0-9])", ""), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    found = lambda pattern, unit: F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + pattern), 1), lambda x: F.concat(short(x), F.lit(unit)))
    return F.array_sort(F.array_distinct(F.concat(found(POINTS, "bp"), found(PARTS, "pct"))))


def cash_tags(text: Column) -> Column:
    """Distinct `$ABC` tickers of two to five capitals, in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$([A-Z]{2,5})(?![A-Za-z0-9])"), 1))


#: What a post may hold beside its own words. Fixed values, read with letters of all scripts as word characters; the first three without regard to case.
LINK = r"(?:(?:https?:)?//|www\.)[^\s<>()]+|(?<![\w@])(?:[a-z0-9-]+\.)+(?:com|org|net|xyz|io|gov|edu)(?:/[^\s<>()]*)?"
REPOST = r"^\s*(?:RT|RETRUTH)\b[\s:：|\-—]*"
ATTRIBUTION = r"^\s*(?:FROM|VIA|BY)\b[\s:：|\-—]*"
MENTION = r"(?<![\w@])@[A-Za-z0-9_]{1,64}\b"
CASHTAG = r"(?<![\w$])\$[A-Za-z][A-Za-z0-9._-]{0,9}\b"


def lettered(text: Column) -> Column:
    """Whether a text has three letters or digits of any script."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", "")) >= 3


def substantive(text: Column) -> Column:
    """Whether something is left beside repost marks, links and mentions: a cashtag, three letters or digits, or two Han characters."""
    bare = F.coalesce(text, F.lit(""))
    for pattern, to in (("(?iU)" + REPOST, ""), ("(?iU)" + ATTRIBUTION, ""), ("(?iU)" + LINK, " "), ("(?U)" + MENTION, " ")):
        bare = F.regexp_replace(bare, pattern, to)
    return once(bare, lambda t: t.rlike("(?U)" + CASHTAG) | (F.length(F.regexp_replace(t, r"(?U)\W+|_", "")) >= 3) | (F.length(F.regexp_replace(t, r"[^\u3400-\u9fff]+", "")) >= 2))


def plain_text(html: Column) -> Column:
    """Text of HTML: scripts, styles and comments dropped, tags to blanks, the five named entities read, blanks single."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))
