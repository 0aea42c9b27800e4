from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from promolift.llm import bpe
from tests.llm.helpers import documents

FILES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")


def both(name):
    vocabulary = bpe.Vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN, cut_at_space=True)
    coder = bpe.Coder(vocabulary.content, vocabulary.pattern, vocabulary.cut_at_space)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    return vocabulary, coder, other


CODERS = {name: both(name) for name in FILES}


@pytest.mark.parametrize("name", FILES)
def test_token_strings_are_encoded_alike(name):
    _, coder, other = CODERS[name]
    random.seed(1)
    tokens = list(coder.ranks)
    for _ in range(2500):
        text = b"".join(random.choices(tokens, k=random.randint(1, 4))).decode(errors="ignore")
        assert coder.encode(text).tolist() == other.encode_ordinary(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abe'st é1\n\t\x1c\x85\xa0\u2003\u3000ऄ日😀", max_size=200))
def test_any_text_is_encoded_alike_and_comes_back(text):
    text = text.encode(errors="ignore").decode()
    for _, coder, other in CODERS.values():
        ids = coder.encode(text)
        assert ids.tolist() == other.encode_ordinary(text)
        assert "".join(coder.decode_chunks(ids)) == text


def test_long_pieces_are_settled_on_the_way(monkeypatch):
    _, coder, other = CODERS[FILES[0]]
    random.seed(2)
    text = "".join(random.choices("abcdefgh", k=30_000)) + "e" * 5000 + "日本" * 2000 + "!" * 3000
    for settle in (7, 512):
        monkeypatch.setattr(bpe, "SETTLE", settle)
        assert coder.encode(text).tolist() == other.encode_ordinary(text)


def test_characters_may_be_split_between_chunks(monkeypatch):
    _, coder, _ = CODERS[FILES[0]]
    monkeypatch.setattr(bpe, "CHUNK_IDS", 1)
    text = "😀 日本 é" * 20
    assert "".join(coder.decode_chunks(coder.encode(text))) == text
    with pytest.raises(UnicodeDecodeError):
        list(coder.decode_chunks(bpe.np.array([coder.ranks[b"\xc3"]])))


def test_table(spark):
    vocabulary, coder, _ = CODERS[FILES[0]]
    rows = [(1, None), (2, ""), (3, "Hello wörld"), (3, "Hello wörld"), (None, " x"), (4, "a b " * 60_000)]
    frame = documents(spark, rows)
    encoded = bpe.encode(frame, vocabulary)
    assert sorted((row.id is None, row.id or 0, row.text) for row in bpe.decode(encoded, vocabulary).collect()) == sorted(
        (number is None, number or 0, text or "") for number, text in rows
    )
    whole = sorted(map(str, bpe.round_trip(frame, vocabulary).collect()))
    assert whole == sorted(map(str, bpe.digests(encoded, vocabulary).collect()))
    for row in bpe.digests(encoded, vocabulary).collect():
        text = next(text or "" for number, text in rows if number == row.id)
        ids = coder.encode(text).tolist()
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(frame.limit(0), vocabulary).collect() == []


def test_whole_texts_and_cut_ones_are_encoded_alike():
    vocabulary, coder, _ = CODERS[FILES[0]]
    whole = bpe.Coder(vocabulary.content, vocabulary.pattern)
    random.seed(4)
    texts = ["".join(random.choices("ab'd é\n\t\xa0\u3000日😀. 12", k=300)) for _ in range(50)] + ["", None]
    for one, other in zip(coder.encode_texts(texts), whole.encode_texts(texts)):
        assert one.tolist() == other.tolist()


def test_pieces_that_begin_alike_are_read_from_where_they_depart(monkeypatch):
    vocabulary, _, _ = CODERS[FILES[0]]
    random.seed(5)
    pieces = [b"".join(random.choices([b"th", b"an", b"er", b"e", "é".encode()], k=random.randint(1, 12))) for _ in range(2000)]
    pieces += [b"", b"the", pieces[0] * 3, pieces[0] * 3 + b"q", pieces[0], b"\x00", b"\x00\x00qz", b"qz" * 40, b"qz" * 40 + b"x"]
    ranks = bpe.Coder(vocabulary.content, vocabulary.pattern).ranks
    alone = [bpe.Transducer(ranks)] * len(pieces)
    expected = [transducer.encode([piece])[0] for transducer, piece in zip(alone, pieces)]
    other = CODERS[FILES[0]][2]
    assert expected == [other._encode_single_piece(piece) if piece else [] for piece in pieces]
    taken = []
    monkeypatch.setattr(bpe._State, "__getitem__", lambda self, byte: taken.append(byte) or dict.__getitem__(self, byte), raising=False)
    for settle in (7, 512):
        monkeypatch.setattr(bpe, "SETTLE", settle)
        taken.clear()
        assert bpe.Transducer(ranks).encode(pieces) == expected
    assert len(taken) < 0.7 * sum(map(len, pieces))
    monkeypatch.setattr(bpe, "MAX_FITS", 50)
    monkeypatch.setattr(bpe, "MAX_MOVES", 50)
    assert bpe.Transducer(ranks).encode(pieces) == expected
