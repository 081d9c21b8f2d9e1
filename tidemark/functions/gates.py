"""Gates: what tells where any of many patterns may be found, far sooner than they do, as it has only the letters that their matches begin with."""

from __future__ import annotations

from collections import defaultdict
from functools import cache
from itertools import groupby
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a beginning at most; beyond this many beginnings a pattern counts as one that can't be told by them.
LETTERS, MOST = 6, 2000
#: Alternatives that are tried one by one; of more, a look at the letter tells which so many to try.
TRIED = 6
_EDGES = ("(?<![a-z0-9])", "(?![a-z0-9])")


def _is_edge(items: list) -> bool:
    """Whether a negative assertion is about letters and digits of ASCII."""
    ranges = {x[1] for x in items[0][1] if x[0] is parser.RANGE} if len(items) == 1 and items[0][0] is parser.IN else set()
    return (48, 57) in ranges and bool(ranges & {(97, 122), (65, 90)}) and all(x[0] is parser.RANGE for x in items[0][1])


def _beginnings(items: list, text: str = "", before: bool = False) -> set[tuple[bool, str, bool]]:
    """(an edge before, letters, an edge after) of which one begins each match of the parsed pattern."""
    done = {(before and text[:1].isalnum(), text, False)}
    if len(text) >= LETTERS or not items:
        return done
    (op, of), rest = items[0], items[1:]
    if op is parser.LITERAL:
        return _beginnings(rest, text + chr(of).lower(), before)
    if op is parser.IN and len(of) <= 4 and all(x[0] is parser.LITERAL for x in of):
        return set().union(*[_beginnings([x, *rest], text, before) for x in of])
    if op is parser.SUBPATTERN:
        return _beginnings([*of[-1], *rest], text, before)
    if op is parser.BRANCH:
        return set().union(*[_beginnings([*branch, *rest], text, before) for branch in of[1]])
    if op is parser.MAX_REPEAT and of[0] == 0 and of[1] == 1:
        return _beginnings(rest, text, before) | _beginnings([*of[2], *rest], text, before)
    if op in (parser.AT, parser.ASSERT, parser.ASSERT_NOT):
        edge = of is parser.AT_BOUNDARY if op is parser.AT else op is parser.ASSERT_NOT and of[0] == (1 if text else -1) and _is_edge(list(of[1]))
        if not text:
            return _beginnings(rest, text, before or edge)
        return {(before and text[0].isalnum(), text, edge and text[-1].isalnum())}
    return done


@cache
def _all_beginnings(patterns: tuple[str, ...]) -> set[tuple[bool, str, bool]] | None:
    found = set().union(*[_beginnings(list(parser.parse(p))) for p in patterns])
    return None if len(found) > MOST or any(not text for _, text, _ in found) else found


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


@cache
def gate(patterns: tuple[str, ...]) -> str | None:
    """A pattern for lower-cased text that is found in each text in which one of the patterns is found, whatever its case; None if there is none such."""
    found = _all_beginnings(patterns)
    if found is None:
        return None
    kinds = defaultdict(set)
    for before, text, after in found:
        kinds[before, after].add(text)
    parts = []
    for (before, after), texts in sorted(kinds.items()):
        by_first = [f"{_escaped(first)}(?:{'|'.join(_escaped(t[1:]) for t in group)})" for first, group in groupby(sorted(texts), key=lambda t: t[0])]
        parts.append(f"{_EDGES[0] * before}(?:{'|'.join(by_first)}){_EDGES[1] * after}")
    return "|".join(parts)


def _tree(ends: set[tuple[str, bool]]) -> str:
    """A pattern of (letters, an edge after), by one letter after the other; of those at a place it finds the longest."""
    parts = []
    by_first = [(_escaped(first), {(text[1:], after) for text, after in group}) for first, group in groupby(sorted(e for e in ends if e[0]), key=lambda e: e[0][0])]
    for k in range(0, len(by_first), TRIED):
        some = by_first[k : k + TRIED]
        guard = f"(?=[{''.join(first for first, _ in some)}])" * (len(by_first) > TRIED)
        parts.append(f"{guard}(?:{'|'.join(first + _tree(rest) for first, rest in some)})")
    if any(not text for text, _ in ends):
        parts.append("" if ("", False) in ends else _EDGES[1])
    return f"(?:{'|'.join(parts)})"


def words(texts: tuple[str, ...]) -> Column:
    """An array of texts, sent to the JVM as one literal; a literal each takes seconds for thousands. No text may have the separator."""
    return F.split(F.lit("\x1f".join(texts)), "\x1f")


def begun(low: Column, patterns: tuple[str, ...]) -> Column:
    """The beginnings of the patterns' matches that a lower-cased text has, each once: at each edge the longest, and all that need no edge before; null if they can't be told."""
    found = _all_beginnings(patterns)
    if found is None:
        return F.lit(None).cast("array<string>")
    none = F.array().cast("array<string>")
    held = lambda texts: F.filter(words(texts), lambda t: F.contains(low, t)) if texts else none
    edged, free = {(text, after) for before, text, after in found if before}, sorted({text for before, text, _ in found if not before})
    other = [text for text in free if not text.isascii()]
    parts = [held([text for text in free if text.isascii()])]
    if edged:
        parts.append(F.regexp_extract_all(F.concat(F.lit(" "), low), F.lit(f"[^a-z0-9](?=({_tree(edged)}))"), F.lit(1)))
    if other:
        # Few texts have letters of these scripts at all.
        letters = sorted(c for text in other for c in text if not c.isascii())
        parts.append(F.when(low.rlike(f"[{_escaped(letters[0])}-{_escaped(letters[-1])}]"), held(other)).otherwise(none))
    return F.array_distinct(F.concat(*parts))


@cache
def openers(some: tuple[str, ...], patterns: tuple[str, ...]) -> tuple[str, ...] | None:
    """Of what `begun` may tell of patterns, that of which one is there wherever one of some of them is found; None if that can't be told."""
    found = _all_beginnings(patterns)
    if found is None:
        return None
    out = set()
    for before, text, _ in _all_beginnings(some):
        out |= {t for edge, t, _ in found if edge and t.startswith(text)} if before else {text}
    return tuple(sorted(out))
