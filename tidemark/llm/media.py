"""Media columns: payloads kept as 8-bit samples in a store of content-defined chunks, and read back from it.

A payload is the text's bytes, filled with bytes 255 to a positive multiple of 576. Its stored form is a mono 8-bit
WAVE file of those samples. The file is cut where a rolling gear hash of the last 32 bytes has its twelve top
bits zero, no chunk under LEAST bytes (but the last) or over MOST. A file is kept as the ordered list of its chunks; chunks whose
digest occurs more than once are kept once, in a table of their own by digest, and the others lie in the list
itself, where no join has to fetch them.

Which digests repeat is counted over all files by a shuffle of digests. The tasks that write the store get a Bloom filter of
the repeated ones, of FILTER_LOAD bits for each, MOST_BITS at most, which bounds the broadcast: what it holds by mistake goes to the shared table too, so only
the place of a chunk depends on it, and the store is exact whatever the filter's load (beyond some 10^8 repeated digests more chunks
move than have to). Reading back joins the lists to the shared table by digest, orders the
chunks, and checks the length and digest of every file; files of equal content are read once.

Defined cases: a null text is empty (one block of bytes 255); equal texts give equal values; repeated rows give a row
each; ids may be null or repeated; an empty table gives an empty result; very long texts are kept whole, a chunk at a time; carried columns named like a result are replaced by it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Aside, stored

#: Bytes of a block of samples, the filling byte, samples a second.
BLOCK, FILL, RATE = 576, 255, 8000
#: Least and greatest bytes of a chunk, top bits of the hash that are zero at a cut (mean 4096 bytes between cuts).
LEAST, MOST, CUT_BITS = 1024, 16384, 12
#: Bits for each repeated digest, least and most bits and hash functions of their filter.
FILTER_LOAD, LEAST_BITS, MOST_BITS, FILTER_HASHES = 10, 1 << 16, 1 << 30, 5
RESULTS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
_HEADER = 44
_GEAR = np.random.Generator(np.random.PCG64(576)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes([FILL]) * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def wave(samples: bytes) -> bytes:
    """A RIFF WAVE file of one channel of unsigned 8-bit samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(samples), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    riff, size, kind = struct.unpack_from("<4sI4s", media)
    data, n = struct.unpack_from("<4sI", media, _HEADER - 8)
    if (riff, kind, data) != (b"RIFF", b"WAVE", b"data") or size + 8 != len(media) or n + _HEADER != len(media):
        raise ValueError("not a file of this store")
    return media[_HEADER:]


def cuts_of(media: bytes) -> list[int]:
    """Ends of the chunks. The hash of the last 2n bytes is that of the first n, moved n bits, plus that of the last n."""
    h = _GEAR[np.frombuffer(media, np.uint8)]
    for n in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[n:] = h[:-n]
        h = (older << np.uint32(n)) + h
    places = np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1
    ends, at, k = [], 0, 0
    while len(media) - at > LEAST:
        k = int(np.searchsorted(places, at + LEAST, side="left"))
        end = int(places[k]) if k < len(places) else len(media)
        at = min(end, at + MOST, len(media))
        ends.append(at)
    if at < len(media):
        ends.append(len(media))
    return ends


def chunks_of(media: bytes) -> list[bytes]:
    ends = cuts_of(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


class DigestFilter:
    """A Bloom filter of digests; their own bytes are its hashes."""

    def __init__(self, bits: int):
        self.bits = np.zeros(bits // 8, np.uint8)
        self.size = bits

    def _places(self, digests: np.ndarray) -> np.ndarray:
        return digests.reshape(-1, 32)[:, : 4 * FILTER_HASHES].copy().view("<u4").astype(np.int64) % self.size

    def add(self, digests: np.ndarray) -> None:
        at = self._places(digests).ravel()
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, digests: np.ndarray) -> np.ndarray:
        at = self._places(digests)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def repeated(texts: DataFrame, bits: int | None = None) -> DigestFilter:
    """The filter, of given bits or by their number, of the digests that occur more than once in texts(body)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(c) for t in batch.column(0) for c in chunks_of(wave(payload_of(t.as_py())))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["digest"])

    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = DigestFilter(bits)
        for batch in batches:
            if len(batch):
                own.add(np.frombuffer(b"".join(bytes(d) for d in batch["digest"]), np.uint8))
        # In pieces, so that the pieces of all tasks are joined by place and not in one task.
        step = len(own.bits) // 64
        rows = [(k, own.bits[k * step : (k + 1) * step].tobytes()) for k in range(64) if own.bits[k * step : (k + 1) * step].any()]
        yield pd.DataFrame(rows, columns=["piece", "bits"])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]])
        return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "bits": [total.tobytes()]})

    often = stored(texts.mapInArrow(listed, "digest binary").groupBy("digest").count().where("count > 1").select("digest"), "repeated-digests")
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (often.count() * FILTER_LOAD).bit_length()))
    out = DigestFilter(bits)
    step = len(out.bits) // 64
    for r in often.mapInPandas(filtered, "piece int, bits binary").groupBy("piece").applyInPandas(joined, "piece int, bits binary").toLocalIterator():
        out.bits[r["piece"] * step : (r["piece"] + 1) * step] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


_FILE = "n_bytes bigint, media_bytes bigint, media_sha256 string, chunks array<struct<digest: binary, body: binary>>"


def write_store(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """docs(carry..., text) -> (files: carry and n_bytes, media_bytes, media_sha256, chunks; shared: digest, body), both in the shared folder.

    A chunk of a file has its body, or if that is null its digest names a row of the shared table.
    """
    texts = docs.select(*carry, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_body"))
    often = docs.sparkSession.sparkContext.broadcast(repeated(texts.select("_body"), bits))
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("body", pa.binary())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, size, sha, lists = [], [], [], []
            for t in batch.column(batch.num_columns - 1):
                text = t.as_py()
                media = wave(payload_of(text))
                chunks = chunks_of(media)
                digests = [digest(c) for c in chunks]
                common = often.value.has(np.frombuffer(b"".join(digests), np.uint8))
                n.append(len(text))
                size.append(len(media))
                sha.append(hashlib.sha256(media).hexdigest())
                # A shared chunk has both here; where the lists are stored it keeps its digest, in the table its body.
                lists.append([{"digest": d if shared else None, "body": c} for d, c, shared in zip(digests, chunks, common.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(sha), pa.array(lists, kind)], names=[*batch.schema.names[:-1], "n_bytes", "media_bytes", "media_sha256", "chunks"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    cut_up = texts.mapInArrow(cut, schema + _FILE)
    named = F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), F.when(c["digest"].isNull(), c["body"]).alias("body")))
    files = stored(cut_up.withColumn("chunks", named), "media-files")
    common = cut_up.select(F.explode(F.filter("chunks", lambda c: c["digest"].isNotNull())).alias("c")).select("c.digest", "c.body")
    return files, stored(common.dropDuplicates(["digest"]), "media-chunks")


def read_store(files: DataFrame, shared: DataFrame) -> DataFrame:
    """(media_sha256, media) of every distinct file, put together from its chunks and checked."""
    whole = F.forall("chunks", lambda c: c["body"].isNotNull())
    apart = files.where(whole).select("media_sha256", F.col("chunks.body").alias("bodies"))
    mixed = files.where(~whole).select("media_sha256", "chunks").dropDuplicates(["media_sha256"])
    places = mixed.select("media_sha256", F.posexplode("chunks").alias("at", "c")).select("media_sha256", "at", "c.digest", "c.body")
    met = places.where(F.col("digest").isNotNull()).drop("body").join(shared, "digest").select("media_sha256", "at", "body")
    ordered = met.unionByName(places.where(F.col("digest").isNull()).select("media_sha256", "at", "body")).groupBy("media_sha256").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("parts"))
    return apart.unionByName(ordered.select("media_sha256", F.col("parts.body").alias("bodies")))


def feature(samples: np.ndarray, chunks: int) -> str:
    """Mean, deviation, crossings of the middle and a sixteen-step histogram of the samples, as text."""
    x = samples.astype(np.float64)
    crossings = int(np.count_nonzero(np.diff(samples >= 128)))
    steps = ",".join(map(str, np.bincount(samples >> 4, minlength=16).tolist()))
    return f"seconds={len(x) / RATE:.3f};mean={x.mean():.4f};std={x.std():.4f};crossings={crossings};chunks={chunks};histogram={steps}"


def features(read: DataFrame) -> DataFrame:
    """read_store's rows -> media_sha256, payload_bytes, payload_sha256, tail_crc32, media_bytes, feature, from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sha, bodies in zip(batch.column(0), batch.column(1), strict=True):
                parts = bodies.as_py()
                media = b"".join(parts)
                if hashlib.sha256(media).hexdigest() != sha.as_py():
                    raise ValueError(f"the store doesn't give back {sha.as_py()}")
                samples = samples_of(media)
                rows.append((sha.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), crc32(samples[-32:]), len(media), feature(np.frombuffer(samples, np.uint8), len(parts))))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = ["media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return read.select("media_sha256", "bodies").mapInArrow(run, "media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, feature string")


def media_features(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(carry..., text) -> the carried columns and RESULTS, from the bytes that the store gives back."""
    aside = Aside(docs, ("text",), RESULTS, carry)
    files, shared = write_store(aside.rows, aside.carry)
    # A file without shared chunks is the only one of its content, unless rows of a task met by chance; one row of each suffices.
    found = features(read_store(files, shared)).dropDuplicates(["media_sha256"])
    return aside.restored(files.select(*aside.carry, "n_bytes", "media_sha256").join(found, "media_sha256"), *RESULTS)
