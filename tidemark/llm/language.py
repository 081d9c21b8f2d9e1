"""Language identification: a linear-chain random field labels each word, its marginals label the text.

Learned from documents of the training folds that carry a language: their words all get it, and in the fit such documents are
joined end to end in threes, so that the field also learns to pass from one language to another as code-switched
text does. The lexicon holds the words that most documents of a language use, counted over all training
documents. The weights are fitted on a bounded sample: of every language that training rows carry, SAMPLE documents divided by the number of
languages, EACH at least, chosen by hash of their texts, and of a longer text than SAMPLE_BYTES a window of so many bytes. All languages are learned, however many.

Defined cases: a null text, or one without a letter, is `und` with score 0 and no runs; ties go to the first language by code point; without
training rows all texts are `und` with score 0; ids may be null or repeated (a null id is the empty string for the fold); very
long texts are labelled whole; other columns pass through, but for those named like a result, which it replaces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import Aside, fold, window_at, with_body
from .counts import about, document_keys, most_frequent

#: Documents in the sample (as many of each language), least of a language, bytes of each, words of a language in the lexicon, passes over the sample.
SAMPLE, EACH, SAMPLE_BYTES, LEXICON, EPOCHS = 1600, 40, 20_000, 2000, 4
RESULTS = ("lang_pred", "score", "runs")
_SCHEMA = "lang_pred string, score double, runs array<struct<start: bigint, end: bigint, lang: string>>"


def train(rows: DataFrame) -> crf.RandomField | None:
    """rows(lang, body) of the training folds -> the fitted field."""
    rows = rows.where(F.col("lang").isNotNull())
    labels = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not labels:
        return None
    number = {name: k for k, name in enumerate(labels)}
    top = most_frequent(document_keys(rows, "lang"), "lang", LEXICON)
    lexicon = np.unique(np.array([r["hash"] for r in top.select("hash").collect()], np.int64).view(np.uint64))
    each = max(EACH, SAMPLE // len(labels))
    some = rows.where(F.length("body") > 0)
    sizes = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
    # Equal texts count once, so a large group of copies doesn't fill the sample.
    part = F.substring(F.col("body"), window_at(F.length("body"), SAMPLE_BYTES, F.col("body")), F.lit(SAMPLE_BYTES)).alias("body")
    some = some.where(about(F.col("body"), F.col("lang"), sizes, each)).select("lang", F.xxhash64("body").alias("h"), part).groupBy("lang", "h").agg(F.first("body").alias("body"))
    taken: Counter[str] = Counter()
    chosen = []
    for r in some.orderBy("h", "lang").limit(2 * each * len(labels)).collect():
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= each:
            chosen.append(r)
    model = crf.RandomField.empty(labels, lexicon)
    order = np.random.default_rng(7).permutation(len(chosen))
    parts = []
    for i in order:
        body = bytes(chosen[i]["body"])
        n = len(crf.Words(np.frombuffer(body, np.uint8), np.array([0, len(body)])))
        parts.append((body, np.full(n, number[chosen[i]["lang"]])))
    joined = [(b"\n".join(t for t, _ in parts[i : i + 3]), np.concatenate([y for _, y in parts[i : i + 3]])) for i in range(0, len(parts), 3)]
    return crf.fit(model, joined, EPOCHS, group=8)


def in_characters(raw: bytes, places: list[dict]) -> list[dict]:
    """Places in bytes (start, end) of a UTF-8 text, in order and apart, as places in characters."""
    if places and not raw.isascii():
        data, at, seen = np.frombuffer(raw, np.uint8), 0, 0
        for p in places:
            for end in ("start", "end"):
                # Bytes that go on with a character, of the part since the last place only.
                seen += p[end] - at - int(np.count_nonzero((data[at : p[end]] & 0xC0) == 0x80))
                at, p[end] = p[end], seen
    return places


def predict(docs: DataFrame, model: crf.RandomField | None, carry: tuple[str, ...]) -> DataFrame:
    """docs(carry..., text) -> the carried columns, lang_pred, score (the largest mean marginal over the text's words) and runs.

    runs has the runs of words that share their likeliest language, as (start, end, lang) in characters. No carried column may be named like a result.
    """
    if model is None:
        return docs.select(*carry, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.expr("cast(array() AS array<struct<start: bigint, end: bigint, lang: string>>)").alias("runs"))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    rows, schema, body = with_body(docs, carry, _SCHEMA, letter)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in crf.shortened(batches):
            texts = batch.column(batch.schema.get_field_index(body)).cast(pa.large_binary())
            means = np.zeros((batch.num_rows, len(m.labels)))
            some = np.asarray(batch.column(batch.schema.get_field_index("_letter")))
            text_of, places = [], []
            for chosen, n, start, size, found in crf.marginals(m, texts):
                first = np.cumsum(n) - n
                means[chosen] = np.add.reduceat(found, first, axis=0) / n[:, None]
                best, text = found.argmax(axis=1), np.repeat(chosen, n)
                new = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (text[1:] != text[:-1]))))
                ends = np.append(new[1:], len(best)) - 1
                text_of.append(text[new])
                places.append(np.stack([best[new], start[new], start[ends] + size[ends]], axis=1))
            some = some & (means.sum(axis=1) > 0)
            best = means.argmax(axis=1)
            names = [m.labels[j] if ok else "und" for j, ok in zip(best.tolist(), some.tolist(), strict=True)]
            score = np.where(some, np.clip(means[np.arange(len(best)), best], 0, 1), 0.0)
            runs: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for t, rows in zip(text_of, places, strict=True):
                for i, (k, a, b) in zip(t.tolist(), rows.tolist(), strict=True):
                    runs[i].append({"start": a, "end": b, "lang": m.labels[k]})
            runs = [in_characters(t.as_py(), own) if ok else [] for t, own, ok in zip(texts, runs, some.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(names, pa.string()), pa.array(score), pa.array(runs, kind)], names=[*batch.schema.names[: len(carry)], *RESULTS])

    return rows.mapInArrow(run, schema)


def training_rows(docs: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), parts) != held).select("lang", F.col("text").cast("binary").alias("body"))


def identify(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), parts: int = 5, held: int = 0) -> DataFrame:
    """docs(doc_id, text, lang) -> carried columns, lang_pred, score and runs, from the field trained on the other folds."""
    aside = Aside(docs, ("doc_id", "text", "lang"), RESULTS, carry)
    return aside.restored(predict(aside.rows, train(training_rows(docs, parts, held)), aside.carry), *RESULTS)
