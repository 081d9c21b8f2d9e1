import hashlib
import io
import random
import wave as wave_module
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import media


def brute_cuts(data):
    ends, at = [], 0
    gear = media._GEAR.tolist()
    while at < len(data):
        end = min(len(data), at + media.MOST)
        for i in range(at + media.LEAST, end + 1):
            h = 0
            for b in data[max(0, i - 32) : i]:
                h = ((h << 1) + gear[b]) % 2**32
            if h >> (32 - media.CUT_BITS) == 0:
                end = i
                break
        at = end if len(data) - at > media.LEAST else len(data)
        ends.append(at)
    return ends


def test_cuts_against_brute_force():
    rng = random.Random(4)
    for n in (0, 1, 620, 1024, 1025, 5000, 40_000):
        data = bytes(rng.choices(range(97, 110), k=n))
        assert media.cuts_of(data) == brute_cuts(data)
    assert media.cuts_of(bytes([255]) * 50_000) == brute_cuts(bytes([255]) * 50_000)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_round_trip(data):
    payload = media.payload_of(data)
    assert len(payload) % 576 == 0 and payload and payload[: len(data)] == data and set(payload[len(data) :]) <= {255}
    file = media.wave(payload)
    with wave_module.open(io.BytesIO(file)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
    assert b"".join(media.chunks_of(file)) == file and media.samples_of(file) == payload


def texts():
    rng = random.Random(9)
    long = ["".join(rng.choices("abcdeé \n", k=n)) for n in (30_000, 9000, 200_000)]
    return ["a", "", None, "a", *long, long[0], long[0] + "tail", "head" + long[0], long[1][:5000] + long[2], "x" * 576, "x" * 577, "é" * 288] + ["same text " * 900] * 30


def test_whole_operator(spark):
    rows = list(enumerate(texts())) + [(None, "a"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS body", "3 AS media_bytes", "4 AS chunks", "5 AS _body")
    got = media.media_features(docs, ("doc_id", "chunks", "_body", "media_bytes")).collect()
    assert all((r.chunks, r._body) == (4, 5) for r in got)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = media.payload_of(raw)
        file = media.wave(payload)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), media.feature(np.frombuffer(payload, np.uint8), len(media.chunks_of(file))))
        assert want in [(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in by[doc_id]]


def test_a_full_filter_moves_chunks_but_changes_nothing(spark):
    docs = spark.createDataFrame(list(enumerate(texts()[:8])), "doc_id long, text string")
    small = media.write_store(docs, bits=512)
    large = media.write_store(docs)
    read = lambda s: sorted((r.media_sha256, r.payload_sha256) for r in media.features(media.read_store(*s)).distinct().collect())
    assert read(small) == read(large)
    assert large[1].count() == large[1].select("digest").distinct().count() > 0


def test_shared_chunks_are_kept_once(spark):
    docs = spark.createDataFrame([(i, "same text " * 900) for i in range(20)], "doc_id long, text string")
    files, shared = media.write_store(docs)
    assert files.selectExpr("forall(chunks, c -> c.body IS NULL) AS x").distinct().collect()[0].x
    assert shared.count() == len(set(media.chunks_of(media.wave(media.payload_of(b"same text " * 900)))))


def test_empty_table(spark):
    assert media.media_features(spark.createDataFrame([], "doc_id long, text string")).count() == 0
