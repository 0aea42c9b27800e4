"""Byte-level BPE as a transducer over bytes, and streaming decoding.

The merges are compiled into a finite-state transducer, determinised lazily. The encoding of a piece of text is the
one sequence of tokens in which every two neighbours are left as they are by the merges, and so the last token of every
prefix is unique. A state is the longest end of what was read that may still grow into a token; there are no more of
them than beginnings of tokens. A transition, made when it is first taken, names the tokens that may end at its byte;
the first of them, from the longest, that may follow the last token of the prefix before it, is the prefix's last
token. Tokens are emitted once all continuations share them, which lags behind by a bounded lookahead: a later token
begins at the end or where one has been opened. Which token may follow which is worked out when first asked. Pieces that
begin alike share the work on their common beginning. Parts of text between spaces, and pieces of them, that came before
are looked up whole, in tables that forget rare ones.

Decoding joins the tokens' bytes in chunks and runs an incremental UTF-8 state machine over them, so characters may be
split between tokens and chunks.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.llm.chunks import ChunkTable, Written, decimals, digest_of_numbers, joined, text_slices
from promolift.llm.common import map_batches, slices

SETTLE = 512
MAX_FITS = 400_000
MAX_MOVES = 1_000_000
CHUNK_IDS = 1 << 16

_coders: dict[bytes, Coder] = {}


def merges(data: bytes, ranks: dict[bytes, int]) -> Iterator[list[bytes]]:
    """The parts before and after every merge: of the neighbours of lowest rank, the leftmost of equals."""
    parts = [data[at : at + 1] for at in range(len(data))]
    yield parts
    while pairs := [(ranks[a + b], at) for at, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        _, at = min(pairs)
        parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        yield parts


class _State(dict):
    """Transitions of a state by byte, made when first taken: the next state, and (length, token, what the token may
    follow) of the tokens that may end at the byte, the longest first."""

    __slots__ = ("owner", "read")

    def __init__(self, owner: Transducer, read: bytes):
        self.owner, self.read = owner, read

    def __missing__(self, byte: int) -> tuple[_State, tuple[tuple[int, int, _Lefts], ...]]:
        self[byte] = move = self.owner.move(self.read + bytes((byte,)))
        return move


class _Lefts(dict):
    """Whether a token may follow another, by the other token, worked out when first asked."""

    __slots__ = ("owner", "token")

    def __init__(self, owner: Transducer, token: int):
        self.owner, self.token = owner, token

    def __missing__(self, left: int) -> bool:
        self.owner.n_fits += 1
        self[left] = fit = self.owner.follows(left, self.token)
        return fit


class Transducer:
    """Bytes to tokens, one piece of text at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.openings = {token[:length] for token in ranks for length in range(1, len(token))}
        self.edges: dict[int, tuple | None] = {}
        self.fits: dict[int, _Lefts] = {}
        self.n_fits = 0
        self.start = _State(self, b"")
        self.states = {b"": self.start}
        self.n_moves = 0

    def move(self, read: bytes) -> tuple[_State, tuple[tuple[int, int, _Lefts], ...]]:
        """The state after ``read``, and the tokens that may end there."""
        self.n_moves += 1
        tails = [read[at:] for at in range(len(read))]
        after = next((tail for tail in tails if tail in self.openings), b"")
        if after not in self.states:
            self.states[after] = _State(self, after)
        ending = []
        for token in (self.ranks[tail] for tail in tails if tail in self.ranks):
            if token not in self.fits:
                self.fits[token] = _Lefts(self, token)
            ending.append((self.lengths[token], token, self.fits[token]))
        return self.states[after], tuple(ending)

    def _forget(self) -> None:
        """Bounds what has been worked out."""
        if self.n_fits > MAX_FITS:
            for lefts in self.fits.values():
                lefts.clear()
            self.n_fits = 0
        if self.n_moves > MAX_MOVES:
            for state in self.states.values():
                state.clear()
            self.n_moves = 0

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The tokens of each piece. Pieces are read in order of their bytes, each from where it departs from the one
        before."""
        found: list[list[int]] = [[]] * len(pieces)
        # The last token and the state of each prefix since the settled boundary, which the first stands for.
        read, last, states = b"", [-1], [self.start]
        for place in sorted(range(len(pieces)), key=pieces.__getitem__):
            piece = pieces[place]
            if piece in self.ranks:  # a piece that is a token stays whole, whatever the merges say
                found[place] = [self.ranks[piece]]
                continue
            self._forget()
            end = min(len(read), len(piece))
            differ = int.from_bytes(read[:end]) ^ int.from_bytes(piece[:end])
            end -= (differ.bit_length() + 7) // 8
            del last[end + 1 :], states[end + 1 :]
            state, out, settled = states[end], [], False
            for byte in piece[end:]:
                state, ending = state[byte]
                end += 1
                for length, token, lefts in ending:
                    if length <= end and lefts[last[end - length]]:
                        last.append(token)
                        break
                else:
                    raise ValueError("the merges give this prefix no tokens; is every byte a token?")
                states.append(state)
                if end >= SETTLE:
                    out += self._settled(last, state.read)
                    end, settled = len(last) - 1, True
            found[place] = out + self._tokens(last, end)
            read = piece
            if settled:
                read, last, states = b"", [-1], [self.start]
        return found

    def _tokens(self, last: list[int], end: int) -> list[int]:
        """The tokens of the prefix of length ``end``."""
        out, lengths = [], self.lengths
        while end:
            token = last[end]
            out.append(token)
            end -= lengths[token]
        return out[::-1]

    def _settled(self, last: list[int], read: bytes) -> list[int]:
        """Take off and return the tokens that every continuation shares: a later token begins at the end or where one
        has been opened, and all those prefixes agree up to some boundary."""
        count = len(last) - 1
        ends = {count, *(count - len(read) + at for at in range(len(read)) if read[at:] in self.openings)}
        while len(ends) > 1:  # walk the latest boundary back until all meet
            latest = max(ends)
            ends.remove(latest)
            ends.add(latest - self.lengths[last[latest]])
        boundary = ends.pop()
        out = self._tokens(last, boundary)
        del last[:boundary]
        return out

    def _edges(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None:
        """The first and the last parts a token goes through while it is merged, each with the rank of the merge that
        ends it; None for a token that the merges never make."""
        if token not in self.edges:
            states = list(merges(self.tokens[token], self.ranks))
            never = len(self.ranks) + 1
            sides = []
            for side in (0, -1):
                parts = list(dict.fromkeys(state[side] for state in states))
                sides.append([*zip(parts, (*(self.ranks[part] for part in parts[1:]), never))])
            self.edges[token] = tuple(sides) if len(states[-1]) == 1 else None
        return self.edges[token]

    def follows(self, left: int, token: int) -> bool:
        """Whether the merges leave the two tokens as they are; left is -1 at the start of a piece.

        Parts come in order of rank, so the parts at the boundary are merged if their rank comes before the merges that
        end either of them (at equal rank the leftmost goes first).
        """
        edges = self._edges(token)
        if edges is None or left < 0:
            return edges is not None
        ends, begins, i, j = self._edges(left)[1], edges[0], 0, 0
        while True:
            (a, a_ends), (b, b_ends) = ends[i], begins[j]
            rank = self.ranks.get(a + b)
            if rank is not None and rank < a_ends and rank <= b_ends:
                return False
            if i + 1 == len(ends) and j + 1 == len(begins):
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1


class Coder:
    def __init__(self, vocabulary: bytes, pattern: str, cut_at_space: bool = False):
        lines = (line.split() for line in vocabulary.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.split = regex.compile(pattern).findall
        self.cut_at_space = cut_at_space
        self.decimals = decimals(max(self.ranks.values()))
        tokens = {rank: token for token, rank in self.ranks.items()}
        self.tokens = Written([tokens.get(rank, b"") for rank in range(max(tokens) + 1)])
        self.pieces = ChunkTable(self._encode_pieces)
        self.table = ChunkTable(self._encode_chunks)

    @cached_property
    def transducer(self) -> Transducer:
        return Transducer(self.ranks)  # decoding needs none

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        return [array("i", ids).tobytes() for ids in self.transducer.encode(pieces)]

    def _encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        parts = [[piece.encode() for piece in self.split(chunk.decode())] for chunk in chunks]
        distinct = list(set(chain.from_iterable(parts)))
        ids = dict(zip(distinct, self.pieces.of(distinct)))
        return [b"".join([ids[piece] for piece in part]) for part in parts]

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids start, with the end."""
        data, starts = joined([(text or "").encode() for text in texts])
        cuts = space_cuts(data) if self.cut_at_space else np.zeros(len(data), bool)
        ids, id_starts = self.table.gather(data, starts, cuts, 1)
        return np.ascontiguousarray(ids[:, 0]), id_starts

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_texts([text])[0]

    def decode_chunks(self, ids: np.ndarray) -> Iterator[str]:
        """Text chunk by chunk; raises UnicodeDecodeError where the tokens are not UTF-8."""
        machine = codecs.getincrementaldecoder("utf-8")("strict")
        for start in range(0, len(ids), CHUNK_IDS):
            yield machine.decode(self.tokens.of(ids[start : start + CHUNK_IDS])[0])
        yield machine.decode(b"", final=True)


def space_cuts(data: np.ndarray) -> np.ndarray:
    """Where a white space of ASCII follows another character, told by its bytes; not all such places are found.

    Bytes from 0x21 to 0x7E are no white space, nor are two-byte characters from lead 0xC3 on, three-byte ones with lead
    0xE0 or from 0xE4 on, and four-byte ones.
    """
    cuts = np.zeros(len(data), bool)
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    cuts[1:] = space[1:] & (data[:-1] >= 0x21) & (data[:-1] <= 0x7E)
    cuts[2:] |= space[2:] & (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
    cuts[3:] |= space[3:] & ((data[:-3] == 0xE0) | (data[:-3] >= 0xE4)) & (data[:-3] <= 0xEF)
    cuts[4:] |= space[4:] & (data[:-4] >= 0xF0)
    return cuts


class Vocabulary:
    """A rank file's content and a split pattern, as sent to tasks; a Python worker compiles it once.

    ``cut_at_space`` says that the pattern never matches a white space behind another character and looks at nothing
    before a match; texts are then split by parts of which most are known already.
    """

    def __init__(self, path: str, pattern: str, cut_at_space: bool = False):
        with open(path, "rb") as file:
            self.content = file.read()
        self.pattern = pattern
        self.cut_at_space = cut_at_space
        self.key = hashlib.sha256(self.content + pattern.encode() + bytes((cut_at_space,))).digest()

    def coder(self) -> Coder:
        if self.key not in _coders:
            _coders.clear()
            _coders[self.key] = Coder(self.content, self.pattern, self.cut_at_space)
        return _coders[self.key]


class _Encode:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = self.vocabulary.coder()
        for batch in text_slices(batches):
            ids, starts = coder.encode_texts(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "ids"])


class _Decode:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = self.vocabulary.coder()
        for batch in slices(batches):
            lists = batch.column("ids")
            texts = ["".join(coder.decode_chunks(lists[row].values.to_numpy())) for row in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])


class _Digest:
    """Texts, or ids where there is such a column, to the digests of ids and of the decoded text."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = self.vocabulary.coder()
        for batch, ids, starts in self._encoded(coder, batches):
            numbers, number_starts = coder.decimals.of(ids)
            rows = []
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                decoded = hashlib.sha256()
                for chunk in coder.decode_chunks(ids[start:end]):
                    decoded.update(chunk.encode())
                joined_ids = digest_of_numbers(numbers, number_starts[start], number_starts[end])
                rows.append((end - start, joined_ids, decoded.hexdigest()))
            kinds = [pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names)

    @staticmethod
    def _encoded(coder: Coder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            if "ids" in batch.schema.names:
                for part in slices(iter([batch])):
                    lists = part.column("ids")
                    starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
                    yield part, lists.flatten().to_numpy(), starts
            else:
                for part in text_slices(iter([batch])):
                    yield part, *coder.encode_texts(part.column("text").to_pylist())


def encode(frame: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``frame``: id and ids (array of int).

    Null texts count as empty and have no ids; repeated rows stay; other columns, whatever their names, are not read;
    an empty table gives an empty result.
    """
    rows = frame.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, _Encode(vocabulary), "id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(id, ids) back to (id, text)."""
    return map_batches(encoded.select("id", "ids"), _Decode(vocabulary), "id long, text string")


_DIGESTS = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(id, ids) to id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (after decoding)."""
    return map_batches(encoded.select("id", "ids"), _Digest(vocabulary), _DIGESTS)


def round_trip(
    frame: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The digests of ``encode`` and ``decode`` in one pass, in which ids don't leave the Python worker."""
    rows = frame.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, _Digest(vocabulary), _DIGESTS)
