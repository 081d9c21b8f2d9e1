"""Linear-chain conditional random fields over the words of texts: features, fitting, marginals.

A word is a run of letters: a-z (capitals lower-cased) and bytes of other letters. Its score for a label is the sum of
weights of its letter trigrams (with two blanks before the word, so that its first letters are trigrams of their own), of
its last and first three letters, and of its entries in a lexicon, which holds words, or also word starts of given
lengths, exactly (by their 64-bit hash). Transitions between labels are learned with them. Everything works on whole
batches of bytes at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import chains

#: Buckets of the hashed trigrams and of the affixes; bytes of text whose features, and whose scores, are held at once, words of a batch of chains.
GRAMS, AFFIXES = 1 << 16, 1 << 15
_BYTES, _SLICE, _WORDS = 1 << 19, 4 << 20, 100_000
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)


def word_hash(word: bytes) -> int:
    """The lexicon's key of a folded word, as Words computes it for all words of a batch."""
    h = 0
    for b in word:
        h = (h * int(_PRIME) + b + 1) % 2**64
    return h


class Words:
    """The words of texts that lie one after the other in data, text k from cuts[k] to cuts[k + 1]."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray):
        letters = _FOLD[data]
        inside = letters > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = cuts[:-1][cuts[:-1] < len(data)]
        first[edges] = inside[edges]
        self.at = np.flatnonzero(inside)  # the places of letters
        self.b = letters[self.at]
        self.new = first[self.at]  # whether a letter starts its word
        self.first = np.flatnonzero(self.new)
        self.length = np.diff(np.append(self.first, len(self.at)))
        self.start = self.at[self.first]  # place of each word in data
        self.text = np.searchsorted(cuts, self.start, side="right") - 1
        self.per_text = np.bincount(self.text, minlength=len(cuts) - 1)

    def __len__(self) -> int:
        return len(self.first)

    def _back(self, k: int) -> np.ndarray:
        """The letter k before each letter, 0 before its word."""
        out = np.zeros(len(self.b), np.uint32)
        out[k:] = self.b[:-k]
        depth = np.arange(len(self.b)) - np.repeat(self.first, self.length)
        out[depth < k] = 0
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of the trigram that ends at each letter, bucket of each word's end, bucket of each word's start)."""
        if not len(self):
            return (np.zeros(0, np.int64),) * 3
        one, two = self._back(1), self._back(2)
        gram = (two << np.uint32(16)) | (one << np.uint32(8)) | self.b
        bucket = lambda x, n, seed: ((x.astype(np.uint64) + np.uint64(seed << 32)) * _MIX >> np.uint64(40)).astype(np.int64) % n
        last = self.first + self.length - 1
        head = np.minimum(self.first + 2, last)
        return bucket(gram, GRAMS, 1), bucket(gram[last], AFFIXES, 2), bucket(gram[head], AFFIXES, 3)

    def hashes(self, letters: int = 0) -> np.ndarray:
        """word_hash of every word, or of its first letters and their number (0 for words with fewer), by Horner's rule."""
        if not len(self):
            return np.zeros(0, np.uint64)
        if letters:
            out = np.full(len(self), letters, np.uint64)
            for k in range(letters):
                out = out * _PRIME + self.b[np.minimum(self.first + k, len(self.b) - 1)].astype(np.uint64) + np.uint64(1)
            return np.where(self.length >= letters, out, np.uint64(0))
        most = int(self.length.max())
        power = np.ones(most, np.uint64)
        if most > 1:
            power[1:] = np.cumprod(np.full(most - 1, _PRIME), dtype=np.uint64)
        left = np.repeat(self.first + self.length - 1, self.length) - np.arange(len(self.b))
        return np.add.reduceat((self.b.astype(np.uint64) + np.uint64(1)) * power[left], self.first)

    def keys(self, starts: tuple[int, ...]) -> list[np.ndarray]:
        """The lexicon keys of every word: itself, and its starts of the given lengths."""
        return [self.hashes(), *(self.hashes(n) for n in starts)]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary or string column and the texts' places in them; a null is empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        valid = np.asarray(column.is_valid())
        cuts = np.concatenate(([cuts[0]], cuts[1:]))
        if (np.diff(cuts)[~valid] > 0).any():
            return texts_of(column.fill_null(b""))
    return bytes_[cuts[0] : cuts[-1]], cuts - cuts[0]


def pieces(data: np.ndarray, cuts: np.ndarray, most: int = _BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes."""
    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + most, side="right")) - 1)
        yield at, to
        at = to


def shortened(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that what is made of a part stays small; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@dataclass
class RandomField:
    """Weights of a random field: rows of features by labels."""

    labels: list
    lexicon: np.ndarray  # sorted hashes of the words it knows
    gram: np.ndarray
    end: np.ndarray
    head: np.ndarray
    lex: np.ndarray
    bias: np.ndarray
    move: np.ndarray
    first: np.ndarray
    starts: tuple[int, ...] = ()

    @staticmethod
    def empty(labels: list, lexicon: np.ndarray, starts: tuple[int, ...] = ()) -> RandomField:
        k = len(labels)
        z = lambda n: np.zeros((n, k), np.float32)
        return RandomField(labels, np.sort(lexicon), z(GRAMS), z(AFFIXES), z(AFFIXES), z(len(lexicon) + 1), np.zeros(k, np.float32), np.zeros((k, k)), np.zeros(k), starts)

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each word in the lexicon's weights; the last row, of weight 0, for others."""
        n = len(self.lexicon)
        if not n:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), n - 1)
        return np.where(self.lexicon[at] == hashes, at, n)

    def scores(self, words: Words) -> np.ndarray:
        """Words by labels."""
        if not len(words):
            return np.zeros((0, len(self.labels)), np.float32)
        gram, end, head = words.features()
        out = np.add.reduceat(self.gram[gram], words.first, axis=0)
        out += self.end[end]
        out += self.head[head]
        for keys in words.keys(self.starts):
            out += self.lex[self.entries(keys)]
        out += self.bias
        return out

    def potentials(self) -> tuple[np.ndarray, np.ndarray]:
        return np.exp(self.first), np.exp(self.move)


def _weights(scores: np.ndarray) -> np.ndarray:
    return np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64))


def marginals(model: RandomField, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Forward-backward over the words of every text that has some, a group of texts of like length at a time.

    Yields (numbers of the texts, their numbers of words, and for these words, text by text: places in the text and lengths, in
    bytes, and marginals of the labels). Only the words' scores are held for more than one group.
    """
    data, cuts = texts_of(column)
    initial, move = model.potentials()
    share = max(1, len(model.labels) // 4)  # of many labels fewer words are held at once
    for low, high in pieces(data, cuts, _SLICE // share):
        found, starts, sizes, counts = [], [], [], []
        for a, b in pieces(data[: cuts[high]], cuts[low : high + 1], _BYTES // share):
            a, b = a + low, b + low
            words = Words(data[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
            found.append(model.scores(words))
            starts.append((words.start - (cuts[a:b] - cuts[a])[words.text]).astype(np.int32))
            sizes.append(words.length.astype(np.int32))
            counts.append(words.per_text)
        per_text, scores, start, size = (np.concatenate(x) for x in (counts, found, starts, sizes))
        del found, starts, sizes
        at = np.cumsum(per_text) - per_text
        for chosen in chains.packs(per_text, _WORDS // share):
            n = per_text[chosen]
            layout = chains.Layout(n)
            rows = np.repeat(at[chosen] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            emit = layout.spread(_weights(scores[rows]))
            alpha, scale = chains.forward(layout, emit, initial, move)
            alpha *= chains.backward(layout, emit, scale, move)
            yield chosen + low, n, start[rows], size[rows], alpha[layout.place]


def _slopes(name: str, where: np.ndarray, off: np.ndarray, k: int) -> tuple[str, np.ndarray, np.ndarray]:
    """The rows of a table of weights that a batch touches, and their slopes."""
    rows, at = np.unique(where, return_inverse=True)
    return name, rows, np.stack([np.bincount(at, weights=off[:, j], minlength=len(rows)) for j in range(k)], axis=1) if len(rows) else np.zeros((0, k))


def fit(model: RandomField, sequences: list[tuple[bytes, np.ndarray]], epochs: int, rate: float = 0.3, decay: float = 1e-6, group: int = 24, seed: int = 42) -> RandomField:
    """Weights by AdaGrad on the conditional likelihood of labelled texts: (text, label of each of its words). A step changes the rows it touches only."""
    rng = np.random.default_rng(seed)
    k = len(model.labels)
    names = ("gram", "end", "head", "lex", "bias", "move", "first")
    past = {n: np.full(np.shape(getattr(model, n)), 1e-3, np.float64) for n in names}
    sequences = [s for s in sequences if len(s[1])]
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), group):
            part = [sequences[i] for i in order[at : at + group]]
            cuts = np.concatenate(([0], np.cumsum([len(t) for t, _ in part])))
            words = Words(np.frombuffer(b"".join(t for t, _ in part), np.uint8), cuts)
            truth = np.concatenate([y for _, y in part])
            gram, end, head = words.features()
            entries = [model.entries(keys) for keys in words.keys(model.starts)]
            layout = chains.Layout(words.per_text[words.per_text > 0])
            emit = layout.spread(_weights(model.scores(words)))
            initial, move = model.potentials()
            alpha, scale = chains.forward(layout, emit, initial, move)
            beta = chains.backward(layout, emit, scale, move)
            pairs = chains.pair_counts(layout, alpha, beta, emit, scale, move)
            off = -(alpha * beta)[layout.place]
            off[np.arange(len(truth)), truth] += 1
            start = np.flatnonzero(np.concatenate(([True], words.text[1:] != words.text[:-1])))
            inner = np.ones(len(truth), bool)
            inner[start] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
            n = len(truth)
            spread = off[np.repeat(np.arange(n), words.length)]
            known = [e < len(model.lexicon) for e in entries]
            parts = [
                ("gram", gram, spread), ("end", end, off), ("head", head, off),
                ("lex", np.concatenate([e[k] for e, k in zip(entries, known, strict=True)]), np.concatenate([off[k] for k in known])),
            ]
            for name, rows, slope in [("bias", slice(None), off.sum(axis=0)), ("move", slice(None), seen - pairs), ("first", slice(None), off[start].sum(axis=0)), *(_slopes(*p, k) for p in parts)]:
                w = getattr(model, name)
                g = slope / np.sqrt(n) - decay * w[rows]
                past[name][rows] += g * g
                w[rows] += (rate * g / np.sqrt(past[name][rows])).astype(w.dtype)
    return model
