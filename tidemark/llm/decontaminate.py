"""Benchmark decontamination by Wu-Manber multi-pattern search.

A pattern is a window of 13 consecutive words of a benchmark item, or all words of an item that has fewer. Texts and
patterns are reduced to words joined by single spaces, so an occurrence is a plain occurrence of bytes between
spaces. Patterns are grouped by length; within a group the first m bytes of each (m: the shortest) fill two tables:
how far a hashed block of bytes lets the scan move on, and, for blocks that end some pattern's first m bytes, the
patterns to compare there directly.

The items are dealt to blocks of about BLOCK_BYTES of text. A task builds the tables of a block, as flat arrays of some eight times its
text, and they are written to the shared folder. The driver passes on as many blocks at once as have PASS_BYTES of tables, by
broadcast, and all documents meet them where they lie. A benchmark of more blocks takes several passes over the documents;
what each finds, by digest of the text, meets the documents in a join. Any number of passes gives the same rows.

Defined cases: a null text has no words; an item without words has no pattern; equal texts of different items
count for each item; a null item id is written as the empty string; repeated rows are judged each for itself; very long texts are searched
whole; an empty benchmark leaves all documents clean; other columns pass through, but for those named like a result (in any case), which it replaces.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Aside, stored, with_body

#: Words of a window, and the part of a document's words (1 / LEAST) that makes it contaminated.
WINDOW, LEAST = 13, 20
#: Bytes of benchmark text in a block, bytes of tables in one pass over the documents.
BLOCK_BYTES, PASS_BYTES = 4 << 20, 192 << 20
#: Shortest patterns of a group of lengths, and the bytes of a block of its tables.
GROUPS = ((40, 12), (16, 6), (4, 3), (1, 1))
RESULTS = ("n_words", "n_hit", "items", "spans", "contaminated")
_FOUND = "items array<string>, spans array<struct<first_word: bigint, n_words: bigint>>"
_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))

#: Byte to itself if it belongs to a word, capitals to small letters, anything else to a space.
_CANONICAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_CANONICAL).split()


def canonical(text: bytes | None) -> bytes:
    """Each word with a space after it, and one before the first; without words, nothing."""
    words = words_of(text) if text else []
    return b" " + b" ".join(words) + b" " if words else b""


def windows_of(canon: bytes, width: int = WINDOW) -> list[tuple[int, int]]:
    """Start and end in a canonical text of each window, with the spaces around it."""
    spaces = np.flatnonzero(np.frombuffer(canon, np.uint8) == 32)
    if len(spaces) < 2:
        return []
    n = max(1, len(spaces) - width)
    return list(zip(spaces[:n].tolist(), (spaces[min(width, len(spaces) - 1) :][:n] + 1).tolist(), strict=True))


class WuManber:
    """Occurrences of many byte patterns, each with any number of owners. Patterns that lie within a common text are kept as places in it."""

    def __init__(self, patterns: dict[bytes, list], text: bytes | None = None, places: list[int] | None = None):
        whole = list(patterns)
        self.owners = list(patterns.values())
        self.text = b"".join(whole) if text is None else text
        self.size = np.fromiter(map(len, whole), np.int64, len(whole))
        self.place = np.cumsum(self.size) - self.size if places is None else np.array(places, np.int64)
        self.groups = []
        rest = np.argsort(-self.size, kind="stable")
        for least, block in GROUPS:
            n = int((self.size[rest] >= least).sum())
            own, rest = rest[:n], rest[n:]
            if n:
                self.groups.append(self._tables([whole[i] for i in own.tolist()], own, block))

    @staticmethod
    def _tables(patterns: list[bytes], numbers: np.ndarray, block: int) -> tuple:
        """(shortest length, block, mask, shift by masked hash of a block, hashes of the last blocks in order, their patterns)."""
        m = min(map(len, patterns))
        skip = min(255, m - block + 1)
        least: dict[int, int] = {}
        for p in patterns:
            for end in range(max(block, m - skip + 1), m + 1):
                h = crc32(p[end - block : end])
                if m - end < least.get(h, skip):
                    least[h] = m - end
        mask = (1 << max(8, (4 * len(least)).bit_length())) - 1
        shift = np.full(mask + 1, skip, np.uint8)
        if least:
            np.minimum.at(shift, np.fromiter(least, np.int64, len(least)) & mask, np.fromiter(least.values(), np.uint8, len(least)))
        last = np.fromiter((crc32(p[m - block : m]) for p in patterns), np.uint32, len(patterns))
        order = np.argsort(last, kind="stable")
        return m, block, mask, shift.tobytes(), last[order], numbers[order]

    def occurrences(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, number of the pattern) of every occurrence."""
        for m, block, mask, shift, keys, numbers in self.groups:
            end, last = m, len(text)
            while end <= last:
                h = crc32(text[end - block : end])
                by = shift[h & mask]
                if by:
                    end += by
                    continue
                at = int(np.searchsorted(keys, h))
                while at < len(keys) and keys[at] == h:
                    k = int(numbers[at])
                    if text.startswith(self.text[self.place[k] : self.place[k] + self.size[k]], end - m):
                        yield end - m, k
                    at += 1
                end += 1

    def find(self, text: bytes) -> list[tuple[int, bytes]]:
        """(start, pattern) of every occurrence."""
        return [(at, self.text[self.place[k] : self.place[k] + self.size[k]]) for at, k in self.occurrences(text)]


def joined_spans(spans: list[tuple[int, int]]) -> list[dict]:
    """(first word, end) intervals as disjoint ones in order."""
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [{"first_word": a, "n_words": b - a} for a, b in out]


def search(canon: bytes, blocks: list[WuManber]) -> tuple[list[str], list[dict]]:
    """(sorted owners, spans of hit words) of a canonical text."""
    places: set[tuple[int, int]] = set()
    owners: set[str] = set()
    for block in blocks:
        for at, k in block.occurrences(canon):
            places.add((at, at + int(block.size[k]) - 1))
            owners.update(block.owners[k])
    spans, word, before = [], 0, 0
    for a, b in sorted(places):
        word += canon.count(b" ", before, a)
        spans.append((word, word + canon.count(b" ", a, b)))
        before = a
    return sorted(owners), joined_spans(spans)


def pattern_blocks(benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, data): the pickled tables of each block of items, in the shared folder."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    block = F.pmod(F.xxhash64("item", "text"), F.lit(max(1, -(-total // block_bytes)))).alias("block")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        owners: dict[bytes, list[str]] = {}
        texts, places, length = [], [], 0
        for item, text in zip(rows["item"], rows["text"], strict=True):
            canon = canonical(bytes(text))
            for a, b in windows_of(canon, width):
                known = owners.setdefault(canon[a:b], [])
                if not known:
                    places.append(length + a)
                if item not in known:
                    known.append(item)
            texts.append(canon)
            length += len(canon)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "data": [pickle.dumps(WuManber(owners, b"".join(texts), places))]})

    return stored(items.select("item", "text", block).groupBy("block").applyInPandas(build, "block bigint, data binary"), "pattern-blocks")


def _passes(blocks: DataFrame, pass_bytes: int) -> list[list[int]]:
    """Numbers of the blocks that go to the tasks together."""
    out, held = [[]], 0
    for r in sorted(blocks.select("block", F.length("data").alias("n")).collect()):
        if out[-1] and held + r["n"] > pass_bytes:
            out.append([])
            held = 0
        out[-1].append(r["block"])
        held += r["n"]
    return out


def _rows(batch: pa.RecordBatch, n_kept: int, canon: list[bytes], found: list[tuple[list[str], list[dict]]]) -> pa.RecordBatch:
    words = [max(0, c.count(b" ") - 1) for c in canon]
    hit = [sum(s["n_words"] for s in spans) for _, spans in found]
    columns = [pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([o for o, _ in found], pa.list_(pa.string())), pa.array([s for _, s in found], _SPANS)]
    return pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *columns], names=[*batch.schema.names[:n_kept], "n_words", "n_hit", "items", "spans"])


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [canonical(x.as_py()) for x in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, least: int = LEAST, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES, carry: tuple[str, ...] | None = None
) -> DataFrame:
    """docs (or their columns in carry) with n_words, n_hit, items (sorted ids of items with occurring windows), spans of hit words, contaminated."""
    spark = docs.sparkSession
    aside = Aside(docs, ("text",), RESULTS, carry)
    n_kept = len(aside.carry)
    blocks = pattern_blocks(benchmark, width, block_bytes)
    passes = _passes(blocks, pass_bytes)
    tables = lambda numbers: spark.sparkContext.broadcast([bytes(r["data"]) for r in blocks.where(F.col("block").isin(numbers)).select("data").collect()] if numbers else [])
    schema = f"n_words bigint, n_hit bigint, {_FOUND}"
    if len(passes) == 1:
        shared = tables(passes[0])
        read, kind, body = with_body(aside.rows, aside.carry, schema)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = [pickle.loads(x) for x in shared.value]
            for batch in batches:
                canon = _texts(batch, body)
                yield _rows(batch, n_kept, canon, [search(c, searches) for c in canon])

        judged = read.mapInArrow(judge, kind)
    else:
        found = None
        for numbers in passes:
            shared = tables(numbers)

            def hits(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                searches = [pickle.loads(x) for x in shared.value]
                for batch in batches:
                    rows = [(d, *f) for d, c in zip(batch.column(0).to_pylist(), _texts(batch, "body"), strict=True) if (f := search(c, searches))[0]]
                    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], _SPANS)]
                    yield pa.RecordBatch.from_arrays(columns, names=["digest", "items", "spans"])

            one = docs.select(F.md5("text").alias("digest"), F.col("text").cast("binary").alias("body")).mapInArrow(hits, f"digest string, {_FOUND}")
            one = stored(one.dropDuplicates(["digest"]), "hits")
            shared.unpersist()
            found = one if found is None else found.unionByName(one)
        # A row a text with hits; equal texts hit in several passes meet here.
        met = found.groupBy("digest").agg(F.flatten(F.collect_list("items")).alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))
        rows = aside.rows.withColumn("digest", F.md5("text")).join(met, "digest", "left").drop("digest")
        read, kind, body = with_body(rows, aside.carry, schema, F.col("_items"), F.col("_spans"))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                items, spans = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
                whole = [joined_spans([(s["first_word"], s["first_word"] + s["n_words"]) for s in own or []]) for own in spans]
                yield _rows(batch, n_kept, _texts(batch, body), [(sorted(set(i or [])), s) for i, s in zip(items, whole, strict=True)])

        judged = read.mapInArrow(joined, kind)
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * least >= F.col("n_words"))
    return aside.restored(judged, "n_words", "n_hit", "items", "spans", contaminated.alias("contaminated"))
