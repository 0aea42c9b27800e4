from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from promolift.llm import chunks, pieces
from tests.llm.helpers import documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("models")


def both(path):
    return pieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=str(path))


def model_file(folder, rule, dummy_prefix, squeeze):
    """The public pieces behind one of the library's own character maps."""
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy_prefix, escape_whitespaces=True)
    compiled = sentencepiece_model_pb2.ModelProto()
    compiled.ParseFromString(own.serialized_model_proto())
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.precompiled_charsmap = compiled.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.add_dummy_prefix = dummy_prefix
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    path = folder / f"{rule}-{dummy_prefix}-{squeeze}.model"
    path.write_bytes(model.SerializeToString())
    return path


MODELS = {"identity": lambda folder: PATH}
for rule in ("nmt_nfkc", "nfkc_cf", "identity"):
    for dummy_prefix in (True, False):
        for squeeze in (True, False):
            MODELS[f"{rule}-{dummy_prefix}-{squeeze}"] = lambda folder, given=(rule, dummy_prefix, squeeze): model_file(
                folder, *given
            )

TEXTS = [
    "", " ", "   ", "a", " a", "a ", "  two  spaces  ", "▁", " ▁ ▁▁x▁y", "a▁ b", "tabs\tand\nlines\r\n", "\x00null\x00",
    "Ｈｅｌｌｏ　ｗｏｒｌｄ ①㍿ ﬁ ½", "ｶﾞｷﾞ ﷺ Å é é ǆ", "日本語のテキスト 한국어 ภาษาไทย", "😀👩‍👩‍👧‍👦 𝒳 \U0010ffff", "<s></s><unk><0x41>",
    " " * 70, "x" * 450, "héé" * 150 + " " * 40 + "日" * 300, "​­﻿zero width", "İstanbul ẞ ŉ",
]


def spans(processor, text):
    return [(piece.begin, piece.end) for piece in processor.encode(text, return_type="proto").pieces]


def check(model, processor, texts):
    coder = model.coder()
    found = coder.encode_texts(texts)
    for row, text in enumerate(texts):
        own = slice(found.starts[row], found.starts[row + 1])
        ids = found.ids[own]
        assert ids.tolist() == processor.encode(text), text
        assert list(zip(found.begins[own].tolist(), found.ends[own].tolist())) == spans(processor, text), text
        assert coder.decode(ids).decode() == processor.decode(ids.tolist()), text


@pytest.mark.parametrize("name", MODELS)
def test_ids_spans_and_text_equal_the_librarys(folder, name):
    model, processor = both(MODELS[name](folder))
    random.seed(3)
    vocabulary = [piece for piece, _, _ in model.pieces]
    mixed = ["".join(random.choices(vocabulary, k=random.randint(1, 6))).replace("▁", " ") for _ in range(400)]
    check(model, processor, TEXTS + mixed)


@pytest.mark.parametrize("name", ["identity", "nmt_nfkc-True-True", "nfkc_cf-False-False"])
def test_any_text(folder, name):
    model, processor = both(MODELS[name](folder))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(max_size=40) | st.text("ab ▁é1\n日😀ｶﾞﬁ　", max_size=80), max_size=4))
    def run(texts):
        check(model, processor, [text.encode(errors="ignore").decode() for text in texts])

    run()


def test_normalising_equals_the_librarys(folder):
    own = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", escape_whitespaces=True)
    compiled = sentencepiece_model_pb2.ModelProto()
    compiled.ParseFromString(own.serialized_model_proto())
    spec = compiled.normalizer_spec
    normaliser = pieces.Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces)
    for text in TEXTS:
        assert normaliser(text)[0].decode().replace(" ", "▁") == own.normalize(text).replace(" ", "▁"), text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 258), max_size=30))
def test_any_ids_are_decoded_alike(ids):
    model, processor = both(PATH)
    assert model.coder().decode(np.array(ids, np.int32)).decode() == processor.decode(ids)


def test_long_chunks_merge_as_short_ones_do(monkeypatch):
    model, processor = both(PATH)
    coder = model.coder()
    random.seed(5)
    chunk = [("".join(random.choices("aeinrst é日😀 ", k=150)).replace(" ", "_")).encode() for _ in range(50)]
    together = coder.encode_chunks(chunk)
    monkeypatch.setattr(pieces, "LONG_CHUNK", 0)
    assert coder.encode_chunks(chunk) == together


def test_the_table_forgets_only_rare_chunks():
    asked = []

    def encode(missing):
        asked.extend(missing)
        return [chunk * 4 for chunk in missing]

    table = chunks.ChunkTable(encode, most=4)
    for k in range(12):
        assert table.of([b"often", b"%d" % k]) == [b"often" * 4, (b"%d" % k) * 4]
    assert asked.count(b"often") == 1 and len(table.young) + len(table.old) <= 8


def test_models_that_are_not_supported_are_refused(folder):
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.pieces[500].type = 4
    (folder / "user.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="BPE"):
        pieces.Model(folder / "user.model")


def test_tables_with_nulls_clashes_long_texts_and_repeats(spark):
    model, processor = both(PATH)
    long = "Ein langer Text ohne Ende, " * 40_000 + "日" * 5000
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (None, "x"), (3, ""), (4, long)]
    found = pieces.encode(documents(spark, rows), model)
    assert found.columns == ["id", "ids", "begins", "ends"]
    got = {(row.id, tuple(row.ids)) for row in found.collect()}
    assert got == {(number, tuple(processor.encode(text or ""))) for number, text in rows}
    back = {(row.id, row.text) for row in pieces.decode(found, model).collect()}
    assert back == {(number, text or "") for number, text in rows}
    digests = pieces.round_trip(documents(spark, rows), model).collect()
    assert sorted(row.n_tokens for row in digests) == sorted(len(processor.encode(text or "")) for _, text in rows)
    for row in digests:
        text = next(text or "" for number, text in rows if number == row.id)
        ids = processor.encode(text)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()
        assert row.spanned_bytes == len(text.encode())
    assert pieces.round_trip(documents(spark, rows).limit(0), model).count() == 0
