"""Requests of bounded length: evidence split so that each request fits after escaping, and summaries packed into as few requests in order.

What a request measures is what is sent: the prompt as text of a JSON message. The segments of a document come in order through one task, which holds the parts of
one chunk (CHUNK characters at most) or one group, never a document.

Defined cases: empty and null texts have no part; a null document is one like others; places in a document order its segments (equal ones by text); metadata that alone exceeds the limit, or a summary that does,
raises an error, as nothing may be left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import CHUNK

#: Characters of a request. A fixed value.
MOST = 28_000
Part = dict


def measured(prompt: str) -> int:
    """Characters of a prompt at the provider's boundary, escapes and all."""
    return len(json.dumps([{"role": "user", "content": prompt}], ensure_ascii=False))


def parts_of(at: int, text: str, most: int) -> Iterator[Part]:
    for start in range(0, len(text), most):
        yield {"at": at, "start": start, "text": text[start : start + most]}


def halves(chunk: list[Part], fits: Callable[[list[Part]], bool]) -> Iterator[list[Part]]:
    """The chunk, or its halves, or theirs, in order, until each fits; a single part is cut in its text."""
    waiting = [chunk]
    while waiting:
        now = waiting.pop()
        if fits(now):
            yield now
        elif len(now) > 1:
            waiting += [now[len(now) // 2 :], now[: len(now) // 2]]
        elif (cut := len(now[0]["text"]) // 2) > 0:
            first = now[0]
            waiting += [[{**first, "start": first["start"] + cut, "text": first["text"][cut:]}], [{**first, "text": first["text"][:cut]}]]
        else:
            raise ValueError("what a request must hold beside its evidence exceeds the limit")


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "at", "text").where(F.length("text") > 0).repartition("doc").sortWithinPartitions("doc", "at", "text")


def bounded(segments: DataFrame, prompt: Callable[[list[Part]], str], most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """segments(doc, at, text) -> (doc, request, place, at, start, text): every character once, in order, each request within the limit.

    prompt makes the request of parts (at, start, text). A chunk of parts is filled up to `chunk` characters and then halved as often as needed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, request, held, size, out = object(), 0, [], 0, []

        def flushed() -> None:
            nonlocal request, held, size
            for piece in halves(held, lambda p: measured(prompt(p)) <= most) if held else ():
                out.extend((doc, request, k, p["at"], p["start"], p["text"]) for k, p in enumerate(piece))
                request += 1
            held, size = [], 0

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.doc != doc and not (pd.isna(row.doc) and doc is None):
                    flushed()
                    doc, request = None if pd.isna(row.doc) else row.doc, 0
                for part in parts_of(row.at, row.text, chunk):
                    if held and size + len(part["text"]) > chunk:
                        flushed()
                    held.append(part)
                    size += len(part["text"])
            yield pd.DataFrame(out, columns=["doc", "request", "place", "at", "start", "text"])
            out = []
        flushed()
        yield pd.DataFrame(out, columns=["doc", "request", "place", "at", "start", "text"])

    kinds = {c: segments.schema[c].dataType.simpleString() for c in ("doc", "at")}
    return _in_order(segments).mapInPandas(run, f"doc {kinds['doc']}, request int, place int, at {kinds['at']}, start int, text string")


def packed(summaries: DataFrame, prompt: Callable[[list[str]], str], most: int = MOST) -> DataFrame:
    """summaries(doc, at, text) -> (doc, at, request): consecutive ones together while their request fits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, request, held = object(), 0, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.doc != doc and not (pd.isna(row.doc) and doc is None):
                    doc, request, held = None if pd.isna(row.doc) else row.doc, 0, []
                if measured(prompt([row.text])) > most:
                    raise ValueError("a summary exceeds the limit of a request")
                if held and measured(prompt([*held, row.text])) > most:
                    request, held = request + 1, []
                held.append(row.text)
                out.append((row.doc, row.at, request))
            yield pd.DataFrame(out, columns=["doc", "at", "request"])

    kinds = {c: summaries.schema[c].dataType.simpleString() for c in ("doc", "at")}
    return _in_order(summaries).mapInPandas(run, f"doc {kinds['doc']}, at {kinds['at']}, request int")
