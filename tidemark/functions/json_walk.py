"""JSON of any depth read token by token: private words taken out, keys given twice found.

A token at a time with a stack of the open containers, so depth is bounded by memory alone. Columns ask for a walk only where a text has something that it could
change or find; the rest stays in the JVM.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words of private holdings: none may be part of a key, nor (but for `cost`, a word of its own) stand in a text. Fixed values.
FORBIDDEN = ("shares", "quantity", "account", "cost", "portfolio", "matched_positions")
IN_TEXT = tuple(w for w in FORBIDDEN if w != "cost")
#: Fields that name something: their value is replaced whole, by a name of its own. Fixed values.
IDENTITIES = ("affected_assets", "affected_markets", "asset_key", "benchmark_asset_key", "matched_asset", "provider_symbol", "proxy_for", "symbol", "ticker", "tickers", "topic_key")
OPAQUE = ("id", "item_id", "source_id")
#: Those where COST is a ticker.
TICKERS = ("affected_assets", "asset_key", "benchmark_asset_key", "matched_asset", "provider_symbol", "proxy_for", "symbol", "ticker", "tickers")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+|"')
_SCALAR = re.compile(r"(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\Z")


class Malformed(ValueError):
    """A text that is no JSON."""


def tokens(text: str) -> Iterator[tuple[str, int, str]]:
    """(kind, open containers, token): key, value, open, close; commas and colons are checked and left out."""
    stack: list[str] = []
    want = "value"  # value, value or close, key, key or close, colon, comma or close, end
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t in "}]":
            if not stack or stack[-1] != t or want not in ("comma or close", "key or close" if t == "}" else "value or close"):
                raise Malformed(t)
            stack.pop()
            yield "close", len(stack), t
        elif t == ",":
            if want != "comma or close":
                raise Malformed(t)
            want = "key" if stack[-1] == "}" else "value"
            continue
        elif t == ":":
            if want != "colon":
                raise Malformed(t)
            want = "value"
            continue
        elif want in ("key", "key or close"):
            if t[0] != '"' or len(t) < 2:
                raise Malformed(t)
            yield "key", len(stack), t
            want = "colon"
            continue
        elif want not in ("value", "value or close"):
            raise Malformed(t)
        elif t in "{[":
            yield "open", len(stack), t
            stack.append("}" if t == "{" else "]")
            want = "key or close" if t == "{" else "value or close"
            continue
        elif (t[0] == '"' and len(t) > 1) or _SCALAR.match(t) or t in ("NaN", "Infinity", "-Infinity"):
            yield "value", len(stack), t
        else:
            raise Malformed(t)
        want = "comma or close" if stack else "end"
    if want != "end":
        raise Malformed("end")


def _bounded(text: str, words: tuple[str, ...]) -> bool:
    return any(re.search(rf"(?<![A-Za-z]){w}(?![A-Za-z])", text, re.I) for w in words)


def public_text(value: str, field: str) -> str:
    """A text as it may be shown in a field."""
    named = lambda name: f"[redacted]-{hashlib.sha256(f'{name}{chr(0)}{value}'.encode()).hexdigest()[:16]}"
    low = field.lower()
    if low in IDENTITIES or low.endswith("_key"):
        ticker = low in TICKERS and value.strip().upper() in ("COST", "US:COST")
        return named(low) if _bounded(value.strip(), IN_TEXT if ticker else FORBIDDEN) else value
    if (low in OPAQUE or low.endswith("_url") or low == "url") and _bounded(value, FORBIDDEN):
        return named(low)
    for word in IN_TEXT:
        value = re.sub(rf"(?<![A-Za-z]){word}(?![A-Za-z])", "[redacted]", value, flags=re.I)
    return value


def redact(text: str) -> str | None:
    """The JSON without pairs whose key holds a forbidden word, its texts as they may be shown, numbers that aren't finite null; null if it is no JSON."""
    out: list[str] = []
    fields, first, dropping = [""], [True], None

    def separate(depth: int, in_array: bool) -> None:
        if in_array and not first[depth]:
            out.append(",")
        first[depth] = False

    kinds: list[str] = []
    try:
        for kind, depth, t in tokens(text):
            if dropping is not None:
                # The dropped pair ends with its value, which may be a container.
                if depth == dropping and kind in ("value", "close"):
                    dropping = None
                continue
            if kind == "key":
                name = json.loads(t, strict=False)
                if any(w in name.lower() for w in FORBIDDEN):
                    dropping = depth
                    continue
                separate(depth, True)
                out.append(t + ":")
                fields[depth] = name
            elif kind == "close":
                kinds.pop()
                fields.pop()
                first.pop()
                out.append(t)
            else:
                separate(depth, depth > 0 and kinds[-1] == "[")
                if kind == "open":
                    out.append(t)
                    kinds.append(t)
                    fields.append(fields[depth])
                    first.append(True)
                elif t[0] == '"':
                    plain = json.loads(t, strict=False)
                    shown = public_text(plain, fields[depth])
                    out.append(t if shown == plain else json.dumps(shown, ensure_ascii=False))
                else:
                    out.append("null" if t in ("NaN", "Infinity", "-Infinity") else t)
    except ValueError:
        return None
    return "".join(out)


def repeated_key(text: str) -> str | None:
    """The first key that an object has twice, of the object that ends first; a blank for what is no JSON; null if there is none."""
    seen: list[tuple[set, list]] = []
    try:
        for kind, _, t in tokens(text):
            if kind == "open":
                seen.append((set(), []))
            elif kind == "key":
                name = json.loads(t, strict=False)
                (seen[-1][1].append if name in seen[-1][0] else seen[-1][0].add)(name)
            elif kind == "close" and (twice := seen.pop()[1]):
                return twice[0]
    except ValueError:
        return " "
    return None


def _walked(use: Callable[[str], str | None]):
    def walked(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else use(t) for t in texts], dtype=object)

    return F.pandas_udf(walked, StringType())


_redact, _repeated = _walked(redact), _walked(repeated_key)


def redacted(payload: Column) -> Column:
    """`redact` of a JSON column; a text without any forbidden word, an escape or a number that isn't finite stays as it is."""
    asked = payload.rlike(r"(?i)" + "|".join(FORBIDDEN) + r"|\\u|NaN|Infinity")
    return F.coalesce(_redact(F.when(asked, payload)), F.when(~asked, payload))


def duplicate_key(payload: Column) -> Column:
    """`repeated_key` of a JSON column."""
    return _repeated(payload)
