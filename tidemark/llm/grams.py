"""N-grams of a batch of texts in an open-addressed table of NumPy arrays.

The texts of a batch become one run of bytes in which words are single-spaced, so that every n-gram is a span of it. A span's key is its XXH64;
the table has at least twice as many slots as there are spans. All spans look at their slots at once: a free slot goes to one of those that want it,
a span whose slot holds the same key and, byte for byte, the same n-gram has found its place, and the others go on to the next slot. Each taken slot
stores the n-gram's bucket (its crc32, modulo the number of buckets) and its count; each occurrence keeps its slot.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import xxhash

#: Spans of up to so many bytes are hashed and compared all together, longer ones by themselves.
SHORT = 32
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # XXH64's primes, fixed values


class Spans:
    """The words and n-grams of texts that lie one after the other in data, text k from cuts[k] to cuts[k + 1].

    Words are runs of a-z (capitals lower-cased), digits and bytes of other letters; words of a text's n-grams are joined by one space.
    """

    def __init__(self, data: np.ndarray, cuts: np.ndarray, longest: int):
        folded = _FOLD[data]
        inside = _WORD[folded]
        before = np.concatenate(([False], inside[:-1]))
        edges = cuts[1:-1][cuts[1:-1] < len(data)]
        before[edges] = False  # a word ends with its text
        start = np.flatnonzero(inside & ~before)
        kept = np.flatnonzero(inside)
        # The words side by side, a space before each.
        rank = np.searchsorted(kept, start)
        lengths = np.diff(np.append(rank, len(kept)))
        self.bytes = np.full(len(kept) + len(start) + 8, 32, np.uint8)
        self.bytes[np.arange(len(kept)) + np.repeat(np.arange(1, len(start) + 1), lengths)] = folded[kept]
        first = rank + np.arange(1, len(start) + 1)
        last = first + lengths
        text = np.searchsorted(cuts, start, side="right") - 1
        self.words = np.bincount(text, minlength=len(cuts) - 1)  # of each text
        starts, ends, of = [], [], []
        for n in range(1, longest + 1):
            whole = text[n - 1 :] == text[: len(text) - n + 1]
            starts.append(first[: len(whole)][whole])
            ends.append(last[n - 1 :][whole])
            of.append(text[: len(whole)][whole])
        self.starts, self.text = np.concatenate(starts), np.concatenate(of)
        self.lengths = np.concatenate(ends) - self.starts

    def __len__(self) -> int:
        return len(self.starts)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64, seed 0, of spans; the data has eight bytes more than any of them."""
    out = lengths.astype(np.uint64) + _P5
    eights = _eights(data)
    short = np.flatnonzero(lengths < SHORT)
    at, left, h = starts[short], lengths[short], out[short]
    for _ in range(SHORT // 8 - 1):
        rows = np.flatnonzero(left >= 8)
        if not len(rows):
            break
        mixed = _turned(h[rows] ^ (_turned(eights[at[rows]] * _P2, 31) * _P1), 27) * _P1 + _P4
        h[rows] = mixed
        at, left = at + np.where(left >= 8, 8, 0), np.where(left >= 8, left - 8, left)
    rows = np.flatnonzero(left >= 4)
    h[rows] = _turned(h[rows] ^ ((eights[at[rows]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at, left = at + np.where(left >= 4, 4, 0), np.where(left >= 4, left - 4, left)
    for _ in range(3):
        rows = np.flatnonzero(left > 0)
        h[rows] = _turned(h[rows] ^ (data[at[rows]].astype(np.uint64) * _P5), 11) * _P1
        at, left = at + 1, left - 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    out[short] = h ^ (h >> np.uint64(32))
    long = np.flatnonzero(lengths >= SHORT)
    view = memoryview(data)
    out[long] = np.fromiter((xxhash.xxh64_intdigest(view[a : a + n]) for a, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)), np.uint64, len(long))
    return out


def same(data: np.ndarray, one: np.ndarray, other: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether spans of equal lengths at two places have the same bytes."""
    eights = _eights(data)
    equal = np.ones(len(one), bool)
    rows = np.flatnonzero((lengths <= SHORT) & (one != other))
    left = lengths[rows]
    for k in range(0, SHORT, 8):
        more = left > k
        rows, left = rows[more], left[more]
        if not len(rows):
            break
        unlike = (eights[one[rows] + k] ^ eights[other[rows] + k]) << (np.uint64(8) * np.maximum(8 - (left - k), 0).astype(np.uint64))
        equal[rows] &= unlike == 0
    view = memoryview(data)
    for k in np.flatnonzero((lengths > SHORT) & (one != other)).tolist():
        a, b, n = int(one[k]), int(other[k]), int(lengths[k])
        equal[k] = view[a : a + n] == view[b : b + n]
    return equal


class GramTable:
    """The distinct n-grams of some spans: slot of each occurrence; bucket and count of each slot."""

    def __init__(self, spans: Spans, buckets: int, keys: np.ndarray | None = None):
        n = len(spans)
        size = 1 << max(1, (2 * n - 1).bit_length())
        keys = hashes(spans.bytes, spans.starts, spans.lengths) if keys is None else keys
        owner = np.full(size, -1, np.int32)  # the occurrence that has taken the slot
        slot = np.zeros(n, np.int32)
        rest, at = np.arange(n, dtype=np.int32), (keys & np.uint64(size - 1)).astype(np.int32)
        while len(rest):
            free = owner[at] < 0
            owner[at[free]] = rest[free]
            holder = owner[at]
            met = (keys[holder] == keys[rest]) & (spans.lengths[holder] == spans.lengths[rest])
            rows = np.flatnonzero(met)
            met[rows] = same(spans.bytes, spans.starts[holder[rows]], spans.starts[rest[rows]], spans.lengths[rest[rows]])
            slot[rest[met]] = at[met]
            rest, at = rest[~met], (at[~met] + 1) & np.int32(size - 1)
        taken = np.flatnonzero(owner >= 0)
        number = np.zeros(size, np.int32)
        number[taken] = np.arange(len(taken))
        self.slot = number[slot]  # among the taken slots
        self.count = np.bincount(self.slot, minlength=len(taken))
        self.first = owner[taken]
        view = memoryview(spans.bytes)
        starts, lengths = spans.starts[self.first].tolist(), spans.lengths[self.first].tolist()
        self.bucket = np.fromiter((crc32(view[a : a + m]) for a, m in zip(starts, lengths, strict=True)), np.uint32, len(taken)) % np.uint32(buckets)

    def by_bucket(self, buckets: int) -> np.ndarray:
        """How many occurrences each bucket has."""
        return np.bincount(self.bucket, weights=self.count, minlength=buckets).astype(np.int64)
