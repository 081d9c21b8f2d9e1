"""Toxicity: a linear-chain random field tags toxic words, their marginals score the text and give the offending places.

Labels are those of whole documents, so tokens are labelled from counts over all labelled training documents, each distinct text once a label: a
word is toxic in a toxic document if it, or its start of 4 or 5 bytes, is typical of toxic ones. It is if at least LEAST toxic texts have it, the
odds that a text with it is toxic are LIFT times those of all texts, and chance would make it so in less than one word of 1 / ALPHA vocabularies like
this (the binomial bound by the Kullback-Leibler divergence from the part of toxic texts, over all words counted). Toxic texts
of the sample in which no word is typical are then tested among themselves, against the counts of all clean texts, for what marks them.

The field is fitted to such tokens on a bounded sample (SAMPLE documents of each label, SAMPLE_BYTES bytes of a longer one, chosen by
hash); its affixes and n-grams also reach words never seen. The lexicon has at most LEXICON entries, those of most toxic texts (then of least hash).
The score of a text is a logistic function, fitted on the same sample, of its most toxic word, of the chance that none of its words is
toxic (marginals under NEGLIGIBLE don't count), and of its length.

Defined cases: a null or empty text has no words and gets the score of a text without toxic words; a document with
several labels is toxic if one says so; labels that are null or whose document is missing are passed over; without
both labels in training every score is 0; ids may be repeated (each row is scored) or null (never labelled); very long texts are scored whole; other columns
pass through, but for those named like a result, which it replaces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import Aside, fold, stored, with_body
from .counts import about, document_keys
from .language import in_characters

#: Documents of each label in the sample, the longest of them, passes over them, least steps of the fit, documents of a step.
SAMPLE, SAMPLE_BYTES, EPOCHS, STEPS, GROUP = 1000, 20_000, 4, 150, 24
#: How many times the odds of all texts those of the texts with a typical word are, least number of toxic ones, words typical by chance in one vocabulary.
LIFT, LEAST, ALPHA = 4.0, 4, 0.05
#: Lengths of word starts, most lexicon entries, least marginal of an offending word and of one that counts, the most that one counts as.
STARTS, LEXICON, OFFENDING, NEGLIGIBLE, SUREST = (4, 5), 5000, 0.5, 0.1, 0.9999
RESULTS = ("score", "predicted", "spans")


@dataclass
class Tagger:
    field: crf.RandomField
    weights: np.ndarray  # of the columns of Marks.evidence

    def score(self, marks: Marks) -> np.ndarray:
        return 1 / (1 + np.exp(-marks.evidence() @ self.weights))


@dataclass
class Marks:
    """What the marginals of toxic words say of the texts of a batch."""

    most: np.ndarray  # largest marginal of a text
    none: np.ndarray  # -log of the chance that none is toxic, over those that aren't negligible
    words: np.ndarray
    text: list[int]  # text, place and length in bytes, and marginal of each offending word
    start: list[int]
    size: list[int]
    marginal: list[float]

    @staticmethod
    def of(field: crf.RandomField, column: pa.Array) -> Marks:
        out = Marks(*(np.zeros(len(column)) for _ in range(3)), [], [], [], [])
        for texts, n, start, size, found in crf.marginals(field, column):
            toxic, first = found[:, 1], np.cumsum(n) - n
            out.most[texts] = np.maximum.reduceat(toxic, first)
            out.none[texts] = np.add.reduceat(np.where(toxic >= NEGLIGIBLE, -np.log1p(-np.minimum(toxic, SUREST)), 0), first)
            out.words[texts] = n
            bad = np.flatnonzero(toxic >= OFFENDING)
            out.text += np.repeat(texts, n)[bad].tolist()
            out.start += start[bad].tolist()
            out.size += size[bad].tolist()
            out.marginal += toxic[bad].tolist()
        return out

    def evidence(self) -> np.ndarray:
        return np.stack([np.ones(len(self.most)), self.most, np.log1p(self.none), np.log1p(self.words)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a ridge logistic regression with balanced classes."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    keep = np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ w)
    return w


def labelled(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """docs(doc_id, body), labels(doc_id, toxic) -> (doc_id, digest, toxic) of the training folds: of rows with one text and label, the least id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Labels may be many: the same join at every size, not a broadcast while they happen to be few.
    marked = docs.where(F.col("body").isNotNull()).select("doc_id", F.md5("body").alias("digest")).join(known.hint("merge"), "doc_id")
    return marked.groupBy("digest", "toxic").agg(F.min("doc_id").alias("doc_id"))


def typical(toxic: Column, all_: Column, rate: float, tested: Column | int) -> Column:
    """Whether `toxic` of the `all_` texts that have a word are more than chance explains, if a part `rate` of all texts is toxic and so many words are tested."""
    p = toxic / all_
    other = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    return (toxic >= LEAST) & (toxic * (1 - rate) >= LIFT * rate * (all_ - toxic)) & (all_ * (p * F.log(p / rate) + other) >= F.log(F.lit(tested) / ALPHA))


def _keys(body: bytes) -> list[np.ndarray]:
    return crf.Words(np.frombuffer(body, np.uint8), np.array([0, len(body)])).keys(STARTS)


def _marking(counts: DataFrame, bodies: list[bytes], sampled: float, clean: int, tested: int) -> list[int]:
    """Keys that mark the toxic texts given, a part `sampled` of all such, against the counts of all clean texts."""
    own = Counter(h for body in bodies for h in np.unique(np.concatenate(_keys(body))).tolist() if h)
    asked = [(int(np.uint64(h).view(np.int64)), n) for h, n in own.items() if n >= LEAST]
    if not asked:
        return []
    spark = counts.sparkSession
    # As many as the words of a bounded sample.
    met = counts.join(F.broadcast(spark.createDataFrame(asked, "hash bigint, own bigint")), "hash")
    like = F.col("own") + (F.col("n") - F.col("t")) * sampled
    rate = len(bodies) / (len(bodies) + clean * sampled)
    return [r["hash"] for r in met.where(typical(F.col("own"), like, rate, tested)).select("hash").collect()]


def _windows(rows: DataFrame, lexicon: list[int]) -> DataFrame:
    """rows(toxic, digest, body) with SAMPLE_BYTES bytes of each longer text: about its first word of the lexicon, or at a place given by its digest."""
    known = np.unique(np.array(lexicon, np.int64).view(np.uint64))

    def cut(digest: str, body: bytes) -> bytes:
        if len(body) <= SAMPLE_BYTES:
            return body
        words = crf.Words(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
        met = np.flatnonzero(np.any([np.isin(k, known) for k in words.keys(STARTS)], axis=0)) if len(words) else []
        last = len(body) - SAMPLE_BYTES
        at = int(words.start[met[0]]) - SAMPLE_BYTES // 2 if len(met) else int(digest[:8], 16) % (last + 1)
        at = min(max(at, 0), last)
        return body[at : at + SAMPLE_BYTES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in crf.shortened(batches, 256):
            found = [cut(d.as_py(), b.as_py()) for d, b in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["toxic", "digest", "body"])

    return rows.mapInArrow(run, rows.schema)


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> Tagger | None:
    """docs(doc_id, text), labels(doc_id, toxic) -> the tagger, from the folds that aren't held out."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("body"))
    known = stored(labelled(docs, labels, parts, held), "labelled")
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return None
    rows = docs.where(F.col("body").isNotNull()).join(known.hint("merge"), "doc_id").where(F.md5("body") == F.col("digest")).select("toxic", "body")
    toxic = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0))
    counts = stored(document_keys(rows, "toxic", STARTS).groupBy("hash").agg(toxic.alias("t"), F.sum("n").alias("n")).where("n > 1"), "word-counts")
    tested, rate = max(1, counts.where(F.col("n") >= LEAST).count()), size[1] / (size[0] + size[1])
    top = counts.where(typical(F.col("t"), F.col("n"), rate, tested)).orderBy(F.desc("t"), "hash").limit(LEXICON)
    lexicon = [r["hash"] for r in top.select("hash").collect()]
    chosen = known.where(about(F.col("doc_id"), F.col("toxic"), size, SAMPLE))
    # About 1.2 * SAMPLE rows a label.
    some = docs.where(F.length("body") > 0).join(F.broadcast(chosen), "doc_id").where(F.md5("body") == F.col("digest"))
    some = _windows(some.select("toxic", "digest", "body"), lexicon).groupBy("toxic", "digest").agg(F.first("body").alias("body")).orderBy("digest", "toxic").limit(3 * SAMPLE)
    sample = [(r["toxic"], bytes(r["body"])) for r in some.collect()]
    as_keys = lambda hashes: np.unique(np.array(hashes, np.int64).view(np.uint64))
    found = as_keys(lexicon)
    plain = [body for y, body in sample if y == 1 and not any(np.isin(k, found).any() for k in _keys(body))]
    part = sum(y for y, _ in sample) / size[1]
    lexicon += _marking(counts, plain, min(1.0, part), size[0], tested) if plain else []
    field = crf.RandomField.empty([0, 1], as_keys(lexicon), STARTS)
    sequences = []
    for y, body in sample:
        hit = np.any([field.entries(k) < len(field.lexicon) for k in _keys(body)], axis=0)
        sequences.append((body, (hit & (y == 1)).astype(np.int64)))
    field = crf.fit(field, sequences, max(EPOCHS, -(-STEPS * GROUP // max(1, len(sequences)))), group=GROUP)
    marks = Marks.of(field, pa.array([s for s, _ in sequences], pa.binary()))
    weights = _logistic(marks.evidence(), np.array([y for y, _ in sample], float), 0.1)
    return Tagger(field, weights)


def tag(docs: DataFrame, tagger: Tagger | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(carry..., text) -> carried columns, score, predicted, spans: (start, end, marginal) of offending words, in characters."""
    aside = Aside(docs, ("text",), RESULTS, carry)
    spans = "array<struct<start: bigint, end: bigint, marginal: double>>"
    if tagger is None:
        return docs.select(*aside.kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.expr(f"cast(array() AS {spans})").alias("spans"))
    rows, schema, body = with_body(aside.rows, aside.carry, f"score double, predicted int, spans {spans}")
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
    n_kept = len(aside.carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in crf.shortened(batches):
            texts = batch.column(batch.schema.get_field_index(body)).cast(pa.large_binary())
            marks = Marks.of(t.field, texts)
            score = t.score(marks)
            places: list[list[dict]] = [[] for _ in range(len(texts))]
            for text, start, size, marginal in zip(marks.text, marks.start, marks.size, marks.marginal, strict=True):
                places[text].append({"start": start, "end": start + size, "marginal": marginal})
            places = [in_characters(text.as_py(), own) if own else own for own, text in zip(places, texts, strict=True)]
            predicted = pa.array((score >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(score), predicted, pa.array(places, kind)], names=[*batch.schema.names[:n_kept], *RESULTS])

    return aside.restored(rows.mapInArrow(run, schema), *RESULTS)
