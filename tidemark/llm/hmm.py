"""A hidden Markov language model: Baum-Welch over all training documents, exact scaled forward scores.

A text is its words, A-Z lower-cased, and one end. States emit a class of words, a class emits the word:

    P(text) = sum over state paths of prod P(state | state before) * P(class | state) * P(word | class)

The end and each of the `own` most frequent words are a class by themselves. Any other word belongs to a class by its last
bytes, in which it has probability (c + 1) / (N_b + V_b + 1) (c: its count, N_b, V_b: tokens and distinct words of
the class in training), and 1 / (N_b + V_b + 1) if it was never seen, as the base does with the whole vocabulary.

Corpus work is spread: word counts are summed by a shuffle; only the `known` most frequent words go to the tasks, the others meet
their counts in a join; expected counts of each Baum-Welch round are summed per task, then in two steps. The driver
sees tables of states by classes. The first values of the model come from a bounded sample (windows of at most START_TOKENS words of
about START_DOCS documents); every round that shapes the model runs over all training documents. Texts of more than PIECE
tokens are gone through piece by piece, the recursions carried over each cut.

Defined cases: a null text is empty and has just its end; repeated rows count and score each by itself; a null id is
the empty string for the fold; without training rows every word is unknown, and the model is uniform; words whose counts agree in their
eight leading bits are known together or not at all; other columns of the table don't appear in the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chains
from .common import fold, stored, window_at
from .counts import about, least_counts

#: Hidden states, rounds of Baum-Welch, words with a class of their own, words whose counts all tasks hold, other classes.
STATES, ROUNDS, OWN, KNOWN, SHARED = 8, 3, 8192, 60_000, 1024
#: The sample that gives the first values: documents, their longest length, rounds, seed.
START_DOCS, START_TOKENS, START_ROUNDS, SEED = 800, 1500, 12, 42
#: Tokens of a piece of a long text.
PIECE = 1 << 18
_END = b""  # no word is empty
_FLUSH = 500_000  # distinct words that a task counts before it passes them on
_TOKENS = 300_000  # tokens of one batch of chains


def tokens(text: bytes | None) -> list[bytes]:
    return [*text.lower().split(), _END] if text else [_END]


def class_of_rare(word: bytes) -> int:
    return crc32(word[-3:]) % SHARED


def word_counts(texts: DataFrame) -> DataFrame:
    """One binary column of texts -> (word, n), the end as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])
            count.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                count.update(tokens(text.as_py()))
                if len(count) >= _FLUSH:
                    yield flushed()
        if count:
            yield flushed()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words: their number, class and count; the sums of the shared classes."""

    number: dict[bytes, int]
    cls: np.ndarray
    log_count: np.ndarray  # log10(c + 1)
    seen: np.ndarray
    own: np.ndarray  # whether the word is a class by itself
    n_own: int
    tokens: int
    distinct: int
    log_shared: np.ndarray  # log10(N_b + V_b + 1)

    @property
    def classes(self) -> int:
        return self.n_own + SHARED


def vocabulary(counts: DataFrame, own: int = OWN, known: int = KNOWN) -> Vocabulary:
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    end = counts.where(F.length("word") == 0).first()
    # Words of like count stay together; an ordered limit would send that many words from each task to the driver.
    least = least_counts(counts.where(F.length("word") > 0).select(F.lit(0).alias("all"), "n"), "all", known).first()
    least = least["least"] if least else None
    top = sorted(((bytes(r["word"]), r["n"]) for r in counts.where((F.length("word") > 0) & (F.col("n") >= F.lit(least))).collect()), key=lambda x: (-x[1], x[0]))
    words = [(_END, end["n"] if end else 0), *top]
    n_own = 1 + min(own, len(top))
    apart = {w for w, _ in words[:n_own]}
    cls = np.array([i if i < n_own else n_own + class_of_rare(w) for i, (w, _) in enumerate(words)], np.uint16)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, v = np.zeros(SHARED), np.zeros(SHARED)
        for batch in batches:
            mine = [(class_of_rare(bytes(w)), k) for w, k in zip(batch["word"], batch["n"], strict=True) if bytes(w) not in apart]
            if mine:
                at, k = np.array(mine, np.int64).T
                n += np.bincount(at, weights=k, minlength=SHARED)
                v += np.bincount(at, minlength=SHARED)
        yield pd.DataFrame({"cls": np.arange(SHARED), "n": n.astype(np.int64), "v": v.astype(np.int64)})

    shared = np.ones(SHARED)
    for r in counts.mapInPandas(sums, "cls int, n bigint, v bigint").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        shared[r["cls"]] = r["n"] + r["v"] + 1
    c = np.array([k for _, k in words], np.float64)
    return Vocabulary({w: i for i, (w, _) in enumerate(words)}, cls, np.log10(c + 1), c > 0, np.arange(len(words)) < n_own, n_own, int(size["n"]), int(size["v"]), np.log10(shared))


#: log_known: sum of log10(c + 1) over the known words; log_shared: sum of log10 of P(word | class) over those of the
#: shared classes, where the words that are not known count as c = 0 until they have met their counts.
ENCODED = "row bigint, n_tokens bigint, known bigint, log_known double, log_shared double, classes binary, rare binary"


def encoded(docs: DataFrame, vocab: Vocabulary, carry: tuple[str, ...]) -> DataFrame:
    """docs(carry..., body) -> the carried columns and ENCODED: classes of the tokens, sums over them, the words not known."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    names = [part.split()[0] for part in ENCODED.split(", ")]

    def one(text: bytes | None, v: Vocabulary) -> tuple:
        words = tokens(text)
        number = np.fromiter((v.number.get(w, -1) for w in words), np.int64, len(words))
        other = np.flatnonzero(number < 0)
        rare = [words[i] for i in other.tolist()]
        held = number[number >= 0] if rare else number
        classes = v.cls[number]
        classes[other] = [v.n_own + class_of_rare(w) for w in rare]
        logs = v.log_count[held]
        divided = v.log_shared[classes[classes >= v.n_own].astype(np.int64) - v.n_own].sum()
        return len(words), int(v.seen[held].sum()), float(logs.sum()), float(logs[~v.own[held]].sum() - divided), classes.tobytes(), b" ".join(rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
        for batch in batches:
            found = [one(text.as_py(), shared.value) for text in batch.column(batch.num_columns - 1)]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(range(row, row + len(found)), pa.int64()), *columns], names=[*batch.schema.names[:-1], *names])
            row += len(found)

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return docs.select(*carry, "body").mapInArrow(run, schema + ENCODED)


@dataclass
class Model:
    initial: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes by states

    @staticmethod
    def of(first: np.ndarray, pairs: np.ndarray, out: np.ndarray) -> Model:
        """From expected counts, each with a little added so that nothing is impossible."""
        k = len(first)
        first, pairs, out = first + 0.1, pairs + 0.1 / k, out + 0.02
        return Model(first / first.sum(), pairs / pairs.sum(axis=1, keepdims=True), out / out.sum(axis=0, keepdims=True))


def _expected(model: Model, sequences: list[np.ndarray], into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Adds the expected counts of class sequences to (initial, transitions, classes by states)."""
    first, pairs, out = into
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    for i in np.flatnonzero(lengths > PIECE).tolist():
        _expected_in_pieces(model, sequences[i], into)
    for chosen in chains.packs(np.where(lengths > PIECE, 0, lengths), _TOKENS):
        layout = chains.Layout(lengths[chosen])
        cls = layout.spread(np.concatenate([sequences[i] for i in chosen.tolist()])).astype(np.int64)
        emit = model.emit[cls]
        alpha, scale = chains.forward(layout, emit, model.initial, model.move)
        beta = chains.backward(layout, emit, scale, model.move)
        pairs += chains.pair_counts(layout, alpha, beta, emit, scale, model.move)
        alpha *= beta
        first += alpha[: layout.alive[0]].sum(axis=0)
        _count(out, cls, alpha)


def _count(out: np.ndarray, cls: np.ndarray, posterior: np.ndarray) -> None:
    for k in range(posterior.shape[1]):
        out[:, k] += np.bincount(cls, weights=posterior[:, k], minlength=len(out))


def _expected_in_pieces(model: Model, sequence: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """_expected of one long sequence: forward over its pieces for what each starts from, then backward with what each ends on."""
    first, pairs, out = into
    pieces = [sequence[a : a + PIECE].astype(np.int64) for a in range(0, len(sequence), PIECE)]
    before = [None]  # the last forward variables of the piece before
    for piece in pieces[:-1]:
        initial = model.initial if before[-1] is None else before[-1] @ model.move
        before.append(chains.forward(chains.Layout(np.array([len(piece)])), model.emit[piece], initial, model.move)[0][-1])
    last = None
    for piece, left in zip(reversed(pieces), reversed(before), strict=True):
        layout, emit = chains.Layout(np.array([len(piece)])), model.emit[piece]
        alpha, scale = chains.forward(layout, emit, model.initial if left is None else left @ model.move, model.move)
        beta = chains.backward(layout, emit, scale, model.move, last)
        pairs += chains.pair_counts(layout, alpha, beta, emit, scale, model.move)
        onward = emit[0] * beta[0] / scale[0]
        if left is None:
            first += alpha[0] * beta[0]
        else:
            pairs += model.move * np.outer(left, onward)
        last = model.move @ onward
        _count(out, piece, alpha * beta)


def log_total(model: Model, sequence: np.ndarray) -> float:
    """Log of the probability of one long sequence, forward over its pieces."""
    initial, total = model.initial, 0.0
    for a in range(0, len(sequence), PIECE):
        piece = sequence[a : a + PIECE].astype(np.int64)
        alpha, scale = chains.forward(chains.Layout(np.array([len(piece)])), model.emit[piece], initial, model.move)
        initial, total = alpha[-1] @ model.move, total + float(np.log(scale).sum())
    return total


def _zeros(states: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))


def first_model(sample: list[np.ndarray], classes: int, states: int = STATES, rounds: int = START_ROUNDS, seed: int = SEED) -> Model:
    """Baum-Welch on the sample, from random emissions and states that tend to stay."""
    rng = np.random.default_rng(seed)
    seen = np.bincount(np.concatenate(sample).astype(np.int64), minlength=classes).astype(float) if sample else np.zeros(classes)
    model = Model.of(np.ones(states), np.eye(states) * 8 + 1, (seen + 0.02)[:, None] * np.exp(rng.normal(0, 0.7, (classes, states))))
    for _ in range(rounds if sample else 0):
        found = _zeros(states, classes)
        _expected(model, sample, found)
        model = Model.of(*found)
    return model


def improved(train: DataFrame, model: Model) -> Model:
    """One round of Baum-Welch over train(classes): counts per task, then summed in two steps."""
    shared = train.sparkSession.sparkContext.broadcast(model)
    classes, states = model.emit.shape

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _zeros(states, classes)
        for batch in batches:
            _expected(shared.value, [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(0)], found)
        task = TaskContext.get().partitionId()
        parts = [np.concatenate([found[0], found[1].ravel()]), *found[2].T]
        yield pa.RecordBatch.from_arrays(
            [pa.array([task % 64] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["task", "part", "sums"]
        )

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float64) for x in rows["sums"]], axis=0)
        return pd.DataFrame({"task": [0], "part": [rows["part"].iloc[0]], "sums": [total.tobytes()]})

    schema = "task int, part int, sums binary"
    found = train.select("classes").mapInArrow(counted, schema).groupBy("task", "part").applyInPandas(summed, schema).groupBy("part").applyInPandas(summed, schema)
    parts = {r["part"]: np.frombuffer(bytes(r["sums"]), np.float64) for r in found.collect()}
    if not parts:
        return model
    return Model.of(parts[0][:states], parts[0][states:].reshape(states, states), np.stack([parts[k + 1] for k in range(states)], axis=1))


def likelihoods(docs: DataFrame, model: Model, carry: tuple[str, ...]) -> DataFrame:
    """Adds log_classes, the log10 probability of a document's class sequence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            sequences = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(batch.num_columns - 1)]
            lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
            out = np.zeros(len(sequences))
            for i in np.flatnonzero(lengths > PIECE).tolist():
                out[i] = log_total(m, sequences[i]) / np.log(10)
            for chosen in chains.packs(np.where(lengths > PIECE, 0, lengths), _TOKENS):
                layout = chains.Layout(lengths[chosen])
                cls = layout.spread(np.concatenate([sequences[i] for i in chosen.tolist()])).astype(np.int64)
                _, scale = chains.forward(layout, m.emit[cls], m.initial, m.move)
                out[chosen] = chains.totals(layout, scale) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], "log_classes"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return docs.select(*carry, "classes").mapInArrow(run, f"{schema}log_classes double")


def fitted(rows: DataFrame, rounds: int = ROUNDS, states: int = STATES, own: int = OWN, known: int = KNOWN) -> tuple[DataFrame, Vocabulary, DataFrame, Model]:
    """rows(doc_id, held_out, body) -> (counts of the training words, vocabulary, all rows encoded, model)."""
    counts = stored(word_counts(rows.where(~F.col("held_out")).select("body")), "word-counts")
    vocab = vocabulary(counts, own, known)
    # What is chosen for the start depends on ids and texts alone, not on how the table is split.
    coded = stored(encoded(rows.withColumn("pick", F.xxhash64("doc_id", "body")), vocab, ("doc_id", "held_out", "pick")), "encoded")
    train = coded.where(~F.col("held_out"))
    # Of a longer text a window; two bytes a class.
    late = window_at(F.col("n_tokens"), START_TOKENS, F.col("pick"))
    window = F.substring(F.col("classes"), 2 * late - 1, F.lit(2 * START_TOKENS)).alias("classes")
    start = train.where(about(F.col("pick"), F.lit(0), {0: train.count()}, START_DOCS)).orderBy("pick", "classes").limit(2 * START_DOCS).select(window)
    model = first_model([np.frombuffer(bytes(r["classes"]), np.uint16) for r in start.collect()], vocab.classes, states)
    for _ in range(rounds):
        model = improved(train, model)
    return counts, vocab, coded, model


def score(docs: DataFrame, parts: int = 7, held: int = 2, rounds: int = ROUNDS, states: int = STATES, own: int = OWN, known: int = KNOWN) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), F.col("text").cast("binary").alias("body"))
    counts, vocab, coded, model = fitted(rows, rounds, states, own, known)
    rare = coded.where(F.length("rare") > 0).select("row", F.explode(F.split(F.col("rare").cast("string"), " ")).alias("w")).select("row", F.col("w").cast("binary").alias("word"))
    met = rare.join(counts, "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("log_rare"), F.count("*").alias("rare_known"))
    found = likelihoods(coded, model, ("doc_id", "held_out", "row", "n_tokens", "known", "log_shared", "log_known")).join(met, "row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    base = F.log10(F.lit(float(vocab.tokens + vocab.distinct + 1)))
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("log_known") + log_rare - F.col("n_tokens") * base).alias("base_score"), (F.col("log_classes") + F.col("log_shared") + log_rare).alias("score"),
    )
