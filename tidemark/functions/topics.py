"""What a text is about: one category and at most two tags, by weighted signs in its title and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import topic_values as V
from .forms import nfkc
from .gates import begun, openers, words


def _patterns(*rules: dict) -> tuple[str, ...]:
    return tuple(pattern for of in rules for signs in of.values() for pattern, *_ in signs)


#: All signs.
_SIGNS = _patterns(V.CATEGORY_RULES, V.TAG_RULES)


def _may(opened: Column, *signs: str) -> Column:
    """Whether one of the signs can be in a text, by the beginnings of all signs in it."""
    by = openers(signs, _SIGNS)
    return F.lit(True) if by is None else F.arrays_overlap(opened, words(by))


def _scored(rules: dict, order: tuple[str, ...], *texts: tuple[Column, Column, Column]) -> Column:
    """(least, place, key) of what has any sign, the strongest first, then by order. Of the title and the evidence: text, its lower case, the beginnings of signs in it.

    Each sign costs a pass over a text, so only those are sought that can be there; in lower case, which is faster, where case doesn't count.
    """
    found = []
    for place, key in enumerate(order):
        signs, score = rules.get(key, ()), F.lit(0)
        for pattern, *weights, exact in signs:
            sign = "(?U)" + (pattern if exact else pattern.lower())
            for (text, low, opened), weight in zip(texts, weights, strict=True):
                score = score + F.when(_may(opened, pattern) & (text if exact else low).rlike(sign), weight).otherwise(0)
        if signs:
            able = reduce(Column.__or__, [_may(opened, *[pattern for pattern, *_ in signs]) for *_, opened in texts])
            score = F.when(able, score).otherwise(0)
        found.append(F.struct((-score).alias("least"), F.lit(place).alias("place"), F.lit(key).alias("key")))
    return F.array_sort(F.filter(F.array(*found), lambda x: x["least"] < 0))


def assigned(rows: DataFrame, title: str = "title", evidence: str = "evidence") -> DataFrame:
    """rows with category, tags and taxonomy_version.

    The category of the highest score, general_interest without any; the strongest subject and the strongest lens, or two of one kind. White space is made single, and only
    the first letters are read, as many as the taxonomy says. Null texts are empty.
    """
    clean = lambda c, most: F.left(F.trim(F.regexp_replace(nfkc(F.coalesce(F.col(c), F.lit(""))), r"(?U)\s+", " ")), F.lit(most))
    read = rows.withColumns({"_title": clean(title, V.TITLE), "_evidence": clean(evidence, V.EVIDENCE)})
    read = read.withColumns({"_low_title": F.lower("_title"), "_low_evidence": F.lower("_evidence")})
    read = read.withColumns({f"_begun{c}": begun(F.col(f"_low{c}"), _SIGNS) for c in ("_title", "_evidence")})
    texts = [tuple(F.col(of + c) for of in ("", "_low", "_begun")) for c in ("_title", "_evidence")]
    kinds = {"_category": (V.CATEGORY_RULES, V.CATEGORIES), "_subjects": (V.TAG_RULES, V.SUBJECTS), "_lenses": (V.TAG_RULES, V.LENSES)}
    read = read.withColumns({name: _scored(rules, order, *texts) for name, (rules, order) in kinds.items()})
    keys = lambda c: F.transform(c, lambda x: x["key"])
    subject, lens = keys(F.slice("_subjects", 1, 1)), keys(F.slice("_lenses", 1, 1))
    # Of two kinds there is one of each; of one kind its two strongest.
    tags = F.when(F.size("_lenses") == 0, keys(F.slice("_subjects", 1, 2))).when(F.size("_subjects") == 0, keys(F.slice("_lenses", 1, 2))).otherwise(F.concat(subject, lens))
    category = F.coalesce(F.get(keys(F.col("_category")), 0), F.lit("general_interest"))
    return read.select(*rows.columns, category.alias("category"), tags.alias("tags"), F.lit(V.VERSION).alias("taxonomy_version"))
