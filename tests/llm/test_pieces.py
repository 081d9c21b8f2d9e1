"""Sentence pieces against the library that reads the same model: ids, spans, decoding, and a compiled character map."""

import random

import numpy as np
import pytest

spm = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

from tidemark.llm import pieces, query_pieces  # noqa: E402

ODD = [
    "", " ", "  ", "a", "  a b  ", "▁", "▁▁a▁", " ▁x", "日本龘語", "龘", "\n\ta\r", "a\x00b", "<s></s><unk><0x41>", "é é ﬁ", "😀 😀😀", "   " * 30 + "x" + " " * 40, "⁇", "�", "龘" * 50, "a" * 3000,
]


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=query_pieces.vocabulary())


@pytest.fixture(scope="module")
def model():
    with open(query_pieces.vocabulary(), "rb") as file:
        return pieces.Model(file.read())


def texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(" ab▁é龘😀.\n0theing") for _ in range(rng.randint(1, 60))) for _ in range(500)]


def split(ids, begins, ends, cuts):
    return [(ids[a:b].tolist(), begins[a:b].tolist(), ends[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]


def test_ids_and_spans(library, model):
    all_texts = texts()
    found = split(*model.encode([t.encode() for t in all_texts]))
    for text, (ids, begins, ends) in zip(all_texts, found, strict=True):
        want = library.encode(text, return_type="proto")
        size = len(text.encode())
        assert ids == [*(p.id for p in want.pieces), 2]
        assert begins == [*(p.begin for p in want.pieces), size]
        assert ends == [*(p.end for p in want.pieces), size]


def test_spans_tile_the_text(model):
    for text in texts():
        _, begins, ends, _ = model.encode([text.encode()])
        ends = ends.tolist()
        assert begins.tolist() == [0, *ends[:-1]] and ends[-1] == len(text.encode())


def test_parts_merged_alone_or_together(model):
    for text in texts():
        for part in model.cut.findall(model.normal(text.encode())[0].decode()):
            if len(part) <= pieces.LONGEST:
                ids, sizes, _ = model._short([part])
                assert (ids.tolist(), sizes.tolist()) == model.ids(part)


def test_a_worker_forgets(library):
    with open(query_pieces.vocabulary(), "rb") as file:
        small = pieces.Model(file.read())
    all_texts, kept = texts(), pieces.CACHE
    pieces.CACHE = 10
    try:
        found = [x for t in all_texts for x in split(*small.encode([t.encode()]))]
    finally:
        pieces.CACHE = kept
    assert [ids for ids, _, _ in found] == library.encode(all_texts, add_eos=True)


def test_decoding(library, model):
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.randrange(400) if rng.random() < 0.6 else rng.randrange(32000) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)
    rows = [library.encode(t, add_eos=rng.random() < 0.5) for t in texts()] + [[], [2], [0, 5], [3 + 0x41], [3 + 0xE9, 3 + 0x9F]]
    cuts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    assert model.decode_all(np.array([i for r in rows for i in r], np.int32), cuts) == [library.decode(r) for r in rows]
    assert model.decode_all(np.zeros(0, np.int32), np.array([0, 0])) == [""]


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf", "identity"])
def test_compiled_character_map(rule):
    """Longest prefixes and their places, against the library's normaliser with the same compiled map."""
    normalizer = spm.SentencePieceNormalizer(rule_name=rule)
    fields = dict(pieces._messages(dict(pieces._messages(normalizer.serialized_model_proto()))[3]))
    own = pieces.Model.__new__(pieces.Model)
    own.map, own.own, own.trim, own.dummy = pieces.CharacterMap(fields.get(2, b"")), [], bool(fields.get(4, 1)), bool(fields.get(3, 1))
    own.blank = pieces.BLANK.encode()
    rng = random.Random(9)
    more = ["".join(rng.choice("ﬁ½㎏é́éＡA ガﾊﾟ　\tİ ß龘​") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    for text in more:
        normal, places = own.normal(text.encode())
        want, offsets = normalizer.normalize(text, with_offsets=True)
        assert normal.decode() == want
        starts = [len(want[:k].encode()) for k in range(len(want) + 1)]
        assert not want or places[starts].tolist() == [len(text[:k].encode()) for k in offsets]


def test_bytes_that_are_no_text(library, model):
    for text in (b"a\xff b", b"\xe9\x9f", b"\xf0\x9f\x98", b"x\xc0\xafy", b"\xed\xa0\x80"):
        ids, begins, ends, _ = model.encode([text])
        assert model.decode(ids.tolist()) == text.decode("utf-8", errors="replace") or model.decode(ids.tolist()).count("�") >= 1
        assert ends[-1] == len(text)


def test_operator(spark, library):
    rows = [(None, None, 1, "x"), (1, "", 2, "x"), (1, "", 2, "x"), (2, "Hello  wörld 龘", 3, "y"), (3, "long " * 30000, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, `a.b``c` string")
    found = pieces.encode(docs, query_pieces.vocabulary(), ("doc_id", "text", "a.b`c", "ids"))
    assert found.columns == ["doc_id", "text", "a.b`c", "ids", "begins", "ends"]
    back = pieces.decode(found, query_pieces.vocabulary(), ("doc_id", "text", "ids", "a.b`c")).collect()
    assert len(back) == 5
    for row in back:
        assert row["ids"] == library.encode(row["text"] or "", add_eos=True)
        assert row["decoded"] == (row["text"] or "")
    assert pieces.encode(docs.limit(0), query_pieces.vocabulary()).count() == 0
