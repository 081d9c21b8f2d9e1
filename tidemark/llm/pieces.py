"""Sentence pieces: texts to ids with the byte span of every piece in the original text, and ids back to texts.

A text is normalised by the longest prefixes that the model's compiled character map has (a double-array trie of byte strings, each with
its replacement); a character without a prefix stays, a byte that is no UTF-8 becomes U+FFFD. For every byte of the normal form the place
that it came from is kept, so that the bounds of a piece there name a span of the original bytes. The normal form is cut
before every run of blanks (where no piece of the vocabulary has a blank after another character; otherwise it stays whole), and each cut is
merged pair by pair, the best score first and the leftmost of equal ones. A worker keeps the pieces of the cuts it has met, CACHE at most.
Characters outside the vocabulary fall back to their bytes; of those the last has the character's span and the others an empty one.

Defined cases: a null text is an empty one; an empty text has no piece but the end id; repeated rows give a row each; very long texts are encoded whole;
a carried column named like a result is replaced by it; an empty table gives an empty result; ids that are null decode to an empty text.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import Aside

#: The blank of the vocabulary, the mark of what is no UTF-8, cuts kept by a worker and the longest of them, bytes of text that are encoded at once.
BLANK, WRONG = "▁", "�"
CACHE, LONGEST, AT_ONCE = 1 << 18, 64, 1 << 20
#: Widths of the tables in which short cuts are merged, the number that stands for no symbol and no merge.
WIDTHS, NOTHING = (4, 8, 12, 16, 24, 40, LONGEST), 1 << 30
#: Kinds of a model's pieces, by their numbers in the file.
NORMAL, UNKNOWN, CONTROL, OWN, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
RESULTS = ("ids", "begins", "ends")


def _messages(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """Replacements of byte strings, looked up in a compiled map: four bytes that give the trie's size, the trie's units, the replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.texts = compiled[4 + size :]
        #: First bytes of any key; a text without them is its own normal form.
        self.starts = frozenset(b for b in range(1, 256) if self.units and self._step(self._child(0), b) is not None)

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if self.units[node] & (1 << 31 | 0xFF) == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes, replacement) of the longest key that the text has at a place."""
        if not self.units:
            return None
        found, node = None, 0
        for end in range(at, len(text)):
            node = self._step(self._child(node), text[end])
            if node is None:
                break
            if self.units[node] >> 8 & 1:
                value = self.units[self._child(node)] & 0x7FFFFFFF
                found = (end + 1 - at, value)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


def _character(text: bytes, at: int) -> int:
    """Bytes of the UTF-8 character at a place, 0 if there is none."""
    head = text[at]
    size = 1 if head < 0x80 else 2 if 0xC2 <= head < 0xE0 else 3 if 0xE0 <= head < 0xF0 else 4 if 0xF0 <= head < 0xF5 else 0
    try:
        return size if size and len(text[at : at + size].decode()) == 1 else 0
    except UnicodeDecodeError:
        return 0


class Model:
    """A byte-pair model from the bytes of its file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds, trainer, normalizer = [], [], {}, {}
        for number, value in _messages(data):
            if number == 1:
                piece = dict(_messages(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_messages(value))
            elif number == 3:
                normalizer = dict(_messages(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or normalizer.get(6) or UNUSED in kinds:
            raise ValueError("only byte-pair models with blanks before words and without own denormalisation or unused pieces are read")
        self.kinds = kinds
        self.merges = {p: (-scores[i], i) for i, p in enumerate(self.pieces) if kinds[i] in (NORMAL, OWN)}
        self.own = sorted((p for i, p in enumerate(self.pieces) if kinds[i] == OWN), key=len, reverse=True)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(kinds)) if kinds[i] == BYTE}
        self.unknown, self.end = kinds.index(UNKNOWN), self.pieces.index(trainer.get(47, b"</s>").decode())
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ")
        self.fallback = bool(trainer.get(35, 0)) and len(self.bytes) == 256
        self.dummy, self.trim = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.blank = BLANK.encode() if normalizer.get(5, 1) else b" "
        self.map = CharacterMap(normalizer.get(2, b""))
        apart = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.merges)
        self.cut = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if apart and self.blank != b" " and not self.own else r"(?s).+")
        self._known = _Numbers()
        self._clear()
        self._pairs()
        # What an id decodes to; bytes are put together first.
        self._texts = [p.replace(BLANK, " ").encode() if k in (NORMAL, OWN) else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        self._texts[self.unknown] = self.unknown_text
        self._bytes = {i: b for b, i in self.bytes.items()}
        # The same for many ids at once: each id's bytes in one run of them, and whether they stand for themselves wherever they are.
        own = [bytes([self._bytes[i]]) if self._bytes.get(i, 255) < 128 else t for i, t in enumerate(self._texts)]
        self._run, self._size = np.frombuffer(b"".join(own), np.uint8), np.array([len(t) for t in own])
        self._at = np.cumsum(self._size) - self._size
        self._alone = np.array([k in (NORMAL, OWN, CONTROL) or self._bytes.get(i, 255) < 128 for i, k in enumerate(kinds)])
        self._blank_first = np.array([k in (NORMAL, OWN) and t.startswith(b" ") for k, t in zip(kinds, self._texts, strict=True)])

    def _pairs(self) -> None:
        """Tables of the merges: the symbols of two halves in one number, their score's place and the piece they make.

        A symbol is a piece's id, or for a letter that is no piece the number of pieces and its code point.
        """
        n = len(self.pieces)
        symbol = lambda part: self.merges[part][1] if part in self.merges else n + ord(part) if len(part) == 1 else -1
        rank = {score: k for k, score in enumerate(sorted({score for score, _ in self.merges.values()}))}
        made = {}
        for piece, (score, i) in self.merges.items():
            for k in range(1, len(piece)):
                left, right = symbol(piece[:k]), symbol(piece[k:])
                if left >= 0 and right >= 0:
                    made[left << 32 | right] = (rank[score], i)
        keys = np.array(sorted(made), np.int64)
        self._made = (np.append(keys, -1), np.array([*(made[k][0] for k in keys.tolist()), NOTHING], np.int32), np.array([*(made[k][1] for k in keys.tolist()), NOTHING], np.int32))
        self._letters = np.full(0x110000, -1, np.int32)
        for piece, (_, i) in self.merges.items():
            if len(piece) == 1:
                self._letters[ord(piece)] = i
        self._lengths = np.array([len(p.encode()) for p in self.pieces])

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the score's place, the piece) of pairs of symbols, both NOTHING where they make none."""
        keys, scores, pieces = self._made
        key = left << 32 | right
        at = np.searchsorted(keys[:-1], key)
        at[keys[at] != key] = len(keys) - 1
        return scores[at], pieces[at]

    def normal(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(the normal form, for each of its bytes and its end the place in the text)."""
        if not text:
            return b"", np.zeros(1, np.int64)
        head = self.blank if self.dummy else b""
        if not self.trim and not (self.map.starts and self.map.starts.intersection(text)) and not self.own and _valid(text):
            raw = np.frombuffer(text, np.uint8)
            # A character's bytes all come from where it starts; a blank may have become longer.
            place = np.maximum.accumulate(np.where((raw & 0xC0) == 0x80, 0, np.arange(len(raw))))
            place = np.repeat(place, np.where(raw == 32, len(self.blank), 1))
            return head + text.replace(b" ", self.blank), np.concatenate((np.zeros(len(head), np.int64), place, [len(text)]))
        out, places, at, blank_before = [], [], 0, self.trim
        while self.trim and at < len(text):
            step, new = self._prefix(text, at)
            if new != b" ":
                break
            at += step
        if at == len(text):
            return b"", np.array([at])
        out.append(head)
        places += [at] * len(head)
        while at < len(text):
            step, new = self._prefix(text, at)
            if blank_before:
                new = new.lstrip(b" ")
            if new:
                blank_before = self.trim and new.endswith(b" ")
                new = new.replace(b" ", self.blank)
                out.append(new)
                places += [at] * len(new)
            elif not self.trim:
                blank_before = False
            at += step
        whole = b"".join(out)
        while self.trim and whole.endswith(self.blank):
            whole = whole[: -len(self.blank)]
            at = places[len(whole)]
        return whole, np.array([*places[: len(whole)], at])

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        """(bytes of the text, their normal form) of the longest known prefix at a place, or of one character."""
        for own in self.own:
            if text.startswith(own.encode(), at):
                return len(own.encode()), own.encode()
        if found := self.map.longest(text, at):
            return found
        size = _character(text, at)
        return (size, text[at : at + size]) if size else (1, WRONG.encode())

    def _symbols(self, part: str) -> list[str]:
        if not self.own:
            return list(part)
        return re.findall("|".join(map(re.escape, self.own)) + "|(?s:.)", part)

    def merged(self, part: str) -> list[str]:
        """The pieces of a part of a normal form: pairs with the best score merged first, the leftmost of equal ones."""
        symbols: list[str] = self._symbols(part)
        fixed = set(self.own)
        after = [*range(1, len(symbols)), -1]
        before = list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and symbols[left] not in fixed and symbols[right] not in fixed:
                both = symbols[left] + symbols[right]
                if both in self.merges:
                    heapq.heappush(heap, (self.merges[both][0], left, right, both))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            if not symbols[left] or after[left] != right or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def ids(self, part: str) -> tuple[list[int], list[int]]:
        """(ids, bytes of the normal form that each stands for) of a part."""
        ids, sizes = [], []
        for piece in self.merged(part):
            known, size = self.merges.get(piece), len(piece.encode())
            if known is None and self.fallback:
                ids += [self.bytes[b] for b in piece.encode()]
                sizes += [0] * (size - 1) + [size]
            elif known is None and ids and ids[-1] == self.unknown:
                sizes[-1] += size  # a run of unknown characters is one piece
            else:
                ids.append(self.unknown if known is None else known[1])
                sizes.append(size)
        return ids, sizes

    def _clear(self) -> None:
        self._known.clear()
        self._ids, self._sizes, self._first = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, parts: list[str]) -> None:
        """The pieces of parts that have just been numbered, in their order."""
        together = np.array([self.fallback and not self.own and len(p) <= LONGEST for p in parts])
        order = np.concatenate((np.flatnonzero(together), np.flatnonzero(~together)))
        short = int(together.sum())
        found = [self._short([parts[k] for k in order[:short].tolist()])] if short else []
        for k in order[short:].tolist():
            ids, sizes = self.ids(parts[k])
            found.append((np.array(ids, np.int32), np.array(sizes, np.int64), np.array([len(ids)])))
        ids, sizes, counts = (np.concatenate([f[k] for f in found]) for k in range(3))
        at, counts = _in_order(order, counts)
        self._ids = np.concatenate((self._ids, ids[at]))
        self._sizes = np.concatenate((self._sizes, sizes[at]))
        self._first = np.concatenate((self._first, self._first[-1] + np.cumsum(counts)))

    def _short(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, bytes of each, pieces of each part) of short parts: all merged together, a pair of every part at each step."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        symbols = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols = np.where(self._letters[symbols] < 0, symbols + len(self.pieces), self._letters[symbols])
        first = np.concatenate(([0], np.cumsum(lengths)))
        kept: list[tuple[np.ndarray, np.ndarray]] = []  # (symbols of finished parts, a row each, and their parts)
        for low, high in zip((0, *WIDTHS[:-1]), WIDTHS, strict=True):
            part = np.flatnonzero((lengths > low) & (lengths <= high))
            at = np.arange(high)
            rows = np.where(at < lengths[part, None], symbols[np.minimum(first[part, None] + at, len(symbols) - 1)], NOTHING)
            best, into = self._pair(rows[:, :-1], rows[:, 1:])
            while len(rows):
                k = best.argmin(axis=1)
                open_ = best[np.arange(len(rows)), k] < NOTHING
                kept.append((rows[~open_], part[~open_]))
                rows, part, best, into, k = rows[open_], part[open_], best[open_], into[open_], k[open_]
                if not len(rows):
                    break
                each, left, right = np.arange(len(rows)), np.maximum(k - 1, 0), np.minimum(k + 1, best.shape[1] - 1)
                rows[each, k] = merged = into[each, k]
                after = np.where(k + 2 < rows.shape[1], rows[each, np.minimum(k + 2, rows.shape[1] - 1)], NOTHING)
                score, piece = self._pair(np.concatenate((np.where(k > 0, rows[each, left], NOTHING), merged)), np.concatenate((merged, after)))
                n = len(rows)
                # The pair before the merged one, that after it (none at either end), and the merged pair itself goes.
                best[each, right], into[each, right] = score[n:], piece[n:]
                best[each, left], into[each, left] = np.where(k > 0, score[:n], best[each, left]), np.where(k > 0, piece[:n], into[each, left])
                rest = np.ones(rows.shape, bool)
                rest[each, k + 1] = False
                rows = rows[rest].reshape(n, -1)
                gone = np.ones(best.shape, bool)
                gone[each, k] = False
                best, into = best[gone].reshape(n, -1), into[gone].reshape(n, -1)
                if not best.shape[1]:
                    kept.append((rows, part))
                    break
        counts = np.zeros(len(parts), np.int64)
        flat, order = [], []
        for rows, part in kept:
            there = rows != NOTHING
            counts[part] = there.sum(axis=1)
            flat.append(rows[there])
            order.append(part)
        order = np.concatenate(order)
        at, counts = _in_order(order, counts[order])
        merged = np.concatenate(flat)[at]
        strange = np.flatnonzero(merged >= len(self.pieces))
        sizes = self._lengths[np.minimum(merged, len(self.pieces) - 1)]
        if not len(strange):
            return merged.astype(np.int32), sizes, counts
        return self._spelt(merged, sizes, counts, strange)

    def _spelt(self, merged: np.ndarray, sizes: np.ndarray, counts: np.ndarray, strange: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces with those outside the vocabulary by their bytes."""
        bytes_ = [chr(c).encode() for c in (merged[strange] - len(self.pieces)).tolist()]
        part = np.repeat(np.arange(len(counts)), counts)
        width = np.ones(len(merged), np.int64)
        width[strange] = [len(b) for b in bytes_]
        merged, sizes = np.repeat(merged, width), np.repeat(sizes, width)
        ends = np.cumsum(width)[strange]
        spots = np.repeat(ends - width[strange], width[strange]) + np.concatenate([np.arange(len(b)) for b in bytes_])
        merged[spots] = [self.bytes[b] for x in bytes_ for b in x]
        sizes[spots] = 0
        sizes[ends - 1] = width[strange]
        return merged.astype(np.int32), sizes, np.bincount(part, weights=width, minlength=len(counts)).astype(np.int64)

    def encode(self, texts: list[bytes], end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends, places of each text in them): the pieces of all texts, with spans in the original bytes; last of each, if asked for, the end id."""
        normal = [self.normal(text) for text in texts]
        parts = [self.cut.findall(n.decode()) for n, _ in normal]
        if len(self._known) > CACHE or len(self._ids) > 8 * CACHE:
            self._clear()
        per_text = list(map(len, parts))
        which = np.fromiter(map(self._known.__getitem__, chain.from_iterable(parts)), np.int64, sum(per_text))
        if new := list(islice(self._known, len(self._first) - 1, None)):
            self._learn(new)
        n = np.diff(self._first)[which]
        at = np.repeat(self._first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ids, sizes = self._ids[at], self._sizes[at]
        pieces = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(per_text, dtype=np.int64)))]
        to = np.concatenate(([0], np.cumsum(sizes)))
        extra = [self.end] if end else []
        out: tuple[list, list, list] = ([], [], [])
        for k, (_, place) in enumerate(normal):
            a, b = pieces[k], pieces[k + 1]
            bounds, last = to[a : b + 1] - to[a], [len(texts[k])] * len(extra)
            for into, found, more in zip(out, (ids[a:b], place[bounds[1:] - sizes[a:b]], place[bounds[1:]]), (extra, last, last), strict=True):
                into += [found, more]
        whole = [np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in out]
        return *whole, pieces + (np.arange(len(pieces)) if end else 0)

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """decode of many rows, row k from cuts[k] to cuts[k + 1]; together those whose pieces stand for themselves, after a first one that begins with the normal form's blank."""
        n = np.diff(cuts)
        count = np.concatenate(([0], np.cumsum(~self._alone[ids])))
        first = ids[np.minimum(cuts[:-1], max(len(ids) - 1, 0))] if len(ids) else np.zeros(len(n), np.int64)
        easy = (n > 0) & (count[cuts[1:]] == count[cuts[:-1]]) & self._blank_first[first] if len(ids) and self.dummy and not self.trim else np.zeros(len(n), bool)
        sizes, at = self._size[ids], self._at[ids]
        begin = cuts[:-1][easy]
        sizes[begin], at[begin] = sizes[begin] - 1, at[begin] + 1
        ends = np.cumsum(sizes)
        whole = self._run[np.repeat(at - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.concatenate(([0], ends))[cuts].tolist()
        return [whole[bounds[k] : bounds[k + 1]].decode() if ok else self.decode(ids[cuts[k] : cuts[k + 1]].tolist()) for k, ok in enumerate(easy.tolist())]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks for the vocabulary's, without the first one that normalising adds; what is no UTF-8 among bytes is U+FFFD."""
        out, run, start = [], bytearray(), True
        strip = self.dummy or self.trim

        def flush() -> None:
            if run:
                out.append(_mended(bytes(run)))
                run.clear()

        for k, i in enumerate(ids):
            if i in self._bytes:
                run.append(self._bytes[i])
                continue
            flush()
            text = self._texts[i]
            if start and any(out):
                start = False
            if start and strip and text.startswith(b" ") and i != self.unknown:
                text = text[1:]
                start = self.trim
            out.append(text)
            if not start and not run:
                out += self._rest(ids, k + 1)
                break
        flush()
        return b"".join(out).decode()

    def _rest(self, ids: list[int], at: int) -> list[bytes]:
        """The texts of ids after the first."""
        rest = ids[at:]
        if self._bytes.keys().isdisjoint(rest):
            return list(map(self._texts.__getitem__, rest))
        out, run = [], bytearray()
        for i in rest:
            byte = self._bytes.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(_mended(bytes(run)))
                run.clear()
            out.append(self._texts[i])
        out.append(_mended(bytes(run)))
        return out


class _Numbers(dict):
    """Numbers in the order of their first use."""

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        return number


def _in_order(order: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists one after the other, of counts each, whose places are order: (where their members are to be taken from, in order of places; counts likewise)."""
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    first, n = (np.cumsum(counts) - counts)[back], counts[back]
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def _valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def _mended(data: bytes) -> bytes:
    """Bytes with U+FFFD for every one that is no part of a UTF-8 character."""
    if _valid(data):
        return data
    out, at = [], 0
    while at < len(data):
        size = _character(data, at)
        out.append(data[at : at + size] if size else WRONG.encode())
        at += size or 1
    return b"".join(out)


@lru_cache(2)
def _loaded(data: bytes) -> Model:
    return Model(data)


def _model(docs: DataFrame, path: str):
    """The bytes of a model's file on the driver's machine, sent to the tasks: a vocabulary, whose size doesn't depend on the data."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), end: bool = True) -> DataFrame:
    """docs(text, ...) -> the carried columns, ids, begins and ends: each piece's first byte in the text and the one after its last."""
    aside = Aside(docs, ("text",), RESULTS, carry)
    rows = aside.rows.select(*aside.carry, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_body"))
    data = _model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(data.value)
        for batch in crf.shortened(batches):
            body = batch.column(batch.num_columns - 1)
            sizes = np.cumsum([0, *(len(t.as_buffer()) for t in body)])
            for a, b in crf.pieces(sizes, sizes, AT_ONCE):
                ids, begins, ends, cuts = model.encode([t.as_py() for t in body[a:b]], end)
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (ids, begins, ends)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], names=[*batch.schema.names[:-1], *RESULTS])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return aside.restored(rows.mapInArrow(run, schema + "ids array<int>, begins array<int>, ends array<int>"), *RESULTS)


def decode(rows: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows(ids, ...) -> the carried columns and decoded, the text of the ids."""
    aside = Aside(rows, ("ids",), ("decoded",), carry)
    data = _model(rows, path)
    listed = aside.rows.select(*aside.carry, F.col("ids").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(data.value)
        for batch in crf.shortened(batches):
            lists = batch.column(batch.num_columns - 1)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            cuts, flat = np.concatenate(([0], np.cumsum(sizes))), lists.flatten().to_numpy()
            for a, b in crf.pieces(cuts, cuts, AT_ONCE // 4):
                part = batch.slice(a, b - a)
                texts = model.decode_all(flat[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "decoded"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in listed.schema.fields[:-1])
    return aside.restored(listed.mapInArrow(run, schema + "decoded string"), "decoded")
