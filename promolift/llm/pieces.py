"""SentencePiece BPE encoding with source spans, and decoding.

A text is normalised by a transducer: at each place the longest entry of the model's compiled character map (a double
array over UTF-8 bytes) is replaced, any other character stays, and for every normalised byte the transducer records the
source byte it comes from. Spaces become the space symbol, with a dummy one in front where the model asks for it.
Normalised text is cut before every run of space symbols, which no piece holds inside, and each distinct chunk is merged
once: of the neighbours whose concatenation is a piece, those with the best score first, the leftmost of equals.
Characters that are no piece fall back to their bytes. Each token's width in normalised bytes and the recorded alignment
project it to its span of source bytes; a fallen-back character is the span of the last of its bytes, the others are
empty.

Inside this module a blank stands for the space symbol, in normalised text and in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.llm.chunks import ChunkTable, Written, decimals, digest_of_numbers, joined, text_slices
from promolift.llm.common import map_batches

SPACE = "▁"
REPLACEMENT = "�"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # types of pieces, as in the model's format
NEVER = 1 << 30
LONG_CHUNK = 200

_coders: dict[bytes, Coder] = {}


class PairTable:
    """Ranks and results of merges by the pair of neighbours, looked up for many pairs at once: open addressing."""

    BITS = 19
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[int, int], merged: dict[int, int]):
        self.bits = max(self.BITS, (4 * len(ranks)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NEVER, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        keys = np.fromiter(ranks, np.int64, len(ranks))
        slots = self._home(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            free = waiting[self.keys[slots[waiting]] < 0]
            self.keys[slots[free]] = keys[free]  # of those that want one slot, one gets it
            waiting = waiting[self.keys[slots[waiting]] != keys[waiting]]
            slots[waiting] = (slots[waiting] + 1) & ((1 << self.bits) - 1)
        self.ranks[slots] = np.fromiter(ranks.values(), np.int32, len(ranks))
        self.merged[slots] = np.fromiter(merged.values(), np.int32, len(ranks))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks, NEVER where the pair does not merge, and the pieces the pairs become."""
        keys = left.astype(np.int64) << 20 | right
        keys[(left < 0) | (right < 0)] = (1 << 40) - 1  # in no table, so the search ends at a free slot
        slots = self._home(keys)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return self.ranks[slots], self.merged[slots]


class CharacterMap:
    """The compiled map: a double array whose leaves point at replacements that end with a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.replacements = compiled[4 + size :]

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, source: bytes, at: int) -> tuple[int, str] | None:
        """Length and replacement of the longest entry that starts here."""
        units, found = self.units, None
        node = self._base(units[0])
        for end in range(at, len(source)):
            node ^= source[end]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != source[end]:
                break
            node ^= self._base(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.replacements[start : self.replacements.index(b"\0", start)].decode()

    @cached_property
    def openings(self) -> set[int]:
        """Bytes with which an entry may start."""
        root = self._base(self.units[0])
        return {b for b in range(256) if (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b}


class Normaliser:
    def __init__(self, character_map: bytes, dummy_prefix: bool, squeeze: bool):
        self.map = CharacterMap(character_map) if character_map else None
        self.dummy_prefix = dummy_prefix
        self.squeeze = squeeze

    def _steps(self, source: bytes, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, replacement) of every step of the transducer over the source bytes."""
        at = skip = 0
        for character in text:
            width = len(character.encode())
            if at < skip:
                at += width
                continue
            entry = self.map.longest(source, at) if self.map and source[at] in self.map.openings else None
            yield (at, at + entry[0], entry[1]) if entry else (at, at + width, character)
            skip = at + entry[0] if entry else at + width
            at += width

    def __call__(self, text: str) -> tuple[bytes, np.ndarray | None]:
        """The normalised bytes and, per byte and for the end, the source byte it comes from.

        None stands for source bytes as they are, behind the dummy prefix if there is one.
        """
        if not self.map and not self.squeeze and SPACE not in text:
            return (" " + text if text and self.dummy_prefix else text).encode(), None
        source = text.encode()
        steps = list(self._steps(source, text))
        first = 0
        if self.squeeze:
            while first < len(steps) and steps[first][2] == " ":
                first += 1
        out, places = [], []
        begin = steps[first][0] if first < len(steps) else len(source)
        if first < len(steps) and self.dummy_prefix:
            out.append(" ")
            places.append(begin)
        after_space, end = self.squeeze, begin
        for start, end, replacement in steps[first:]:
            part = replacement.lstrip(" ") if after_space else replacement
            if part:
                canonical = part.replace(SPACE, " ")
                out.append(canonical)
                places += [start] * len(canonical.encode())
                after_space = self.squeeze and part.endswith(" ")
        normalised = "".join(out)
        if self.squeeze and normalised.endswith(" "):
            kept = len(normalised.rstrip(" ").encode())
            end, places = places[kept], places[:kept]
            normalised = normalised.rstrip(" ")
        return normalised.encode(), np.array([*places, end], np.int64)


class Coder:
    def __init__(self, pieces: list[tuple[str, float, int]], normaliser: Normaliser, unknown_surface: str):
        self.normalise = normaliser
        canonical = [piece.replace(SPACE, " ") for piece, _, _ in pieces]
        kinds = [kind for _, _, kind in pieces]
        self.numbers = {canonical[n]: n for n, kind in enumerate(kinds) if kind == NORMAL}
        self.bytes = {int(piece[3:5], 16): n for n, (piece, _, kind) in enumerate(pieces) if kind == BYTE}
        self.is_byte = np.array([kind == BYTE for kind in kinds])
        self.opens_with_space = np.array([kind == NORMAL and piece.startswith(" ") for piece, kind in zip(canonical, kinds)])
        spoken = {NORMAL: lambda n: canonical[n].encode(), BYTE: lambda n: bytes((int(pieces[n][0][3:5], 16),))}
        spoken |= {CONTROL: lambda n: b"", UNKNOWN: lambda n: unknown_surface.encode()}
        self.surfaces = Written([spoken[kind](n) for n, kind in enumerate(kinds)])
        self.decimals = decimals(len(pieces) - 1)
        self.widths = np.array([len(piece.encode()) for piece in canonical], np.int32)
        scores = sorted({np.float32(pieces[n][1]) for n in self.numbers.values()}, reverse=True)
        places = {score: place for place, score in enumerate(scores)}
        ranks: dict[int, int] = {}  # by the pair of neighbours
        merged: dict[int, int] = {}
        for piece, number in self.numbers.items():
            for cut in range(1, len(piece)):
                left, right = self.numbers.get(piece[:cut]), self.numbers.get(piece[cut:])
                if left is not None and right is not None:
                    pair = left << 20 | right
                    ranks[pair] = places[np.float32(pieces[number][1])]
                    merged[pair] = number
        self.ranks, self.merged = ranks, merged
        self.pairs = PairTable(ranks, merged)
        self.characters = np.full(0x110000, -1, np.int32)
        for piece, number in self.numbers.items():
            if len(piece) == 1:
                self.characters[ord(piece)] = number
        self.cuts_hold = not any(" " in piece.lstrip(" ") for piece in self.numbers)
        self.table = ChunkTable(self.encode_chunks)

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """(id, width in normalised bytes) of each token of every chunk, packed."""
        out: list[bytes] = [b""] * len(chunks)
        texts = [chunk.decode() for chunk in chunks]
        short = [place for place, text in enumerate(texts) if len(text) <= LONG_CHUNK]
        for place, text in enumerate(texts):
            if len(text) > LONG_CHUNK:
                out[place] = self._packed(self._merge_long(text))
        lengths = np.fromiter((len(texts[place]) for place in short), np.int64, len(short))
        points = np.frombuffer("".join([texts[place] for place in short]).encode("utf-32-le"), np.uint32)
        symbols, kept = self._merge_together(self.characters[points], lengths)
        ends = np.concatenate(([0], np.cumsum(kept)[np.cumsum(lengths) - 1])) if len(short) else np.zeros(1, np.int64)
        symbols, points = symbols[kept], points[kept]
        known = symbols >= 0
        rows = np.stack([symbols, self.widths[symbols]], axis=1).astype(np.int32).tobytes()
        unknown_before = np.concatenate(([0], np.cumsum(~known)))
        for place, start, end in zip(short, ends[:-1].tolist(), ends[1:].tolist()):
            if unknown_before[start] == unknown_before[end]:
                out[place] = rows[8 * start : 8 * end]
            else:
                own = np.where(known[start:end], symbols[start:end], ~points[start:end].astype(np.int64))
                out[place] = self._packed(own.tolist())
        return out

    def _packed(self, symbols: list[int]) -> bytes:
        """Symbols below zero are the complements of characters that are no piece."""
        out: list[int] = []
        for symbol in symbols:
            if symbol >= 0:
                out += (symbol, int(self.widths[symbol]))
                continue
            spelled = chr(~symbol).encode()
            for place, byte in enumerate(spelled, 1):
                out += (self.bytes[byte], len(spelled) if place == len(spelled) else 0)
        return np.array(out, np.int32).tobytes()

    def _merge_together(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all chunks at once, one merge a chunk in each round: symbols, and a mask of those that are left."""
        symbols, kept = symbols.copy(), np.ones(len(symbols), bool)
        place = np.arange(len(symbols))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        ranks = np.full(len(symbols), NEVER, np.int32)  # of a symbol and the next one of its chunk
        merged = np.zeros(len(symbols), np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inner], merged[inner] = self.pairs.find(symbols[inner], symbols[inner + 1])
        while len(place):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(ranks, first)
            sizes = np.diff(np.append(first, len(place)))
            alive = np.repeat(best < NEVER, sizes)
            place, owner, ranks, merged = place[alive], owner[alive], ranks[alive], merged[alive]
            if not len(place):
                break
            least = np.flatnonzero(ranks == np.repeat(best[best < NEVER], sizes[best < NEVER]))
            at = least[np.concatenate(([True], owner[least[1:]] != owner[least[:-1]]))]
            symbols[place[at]] = merged[at]
            kept[place[at + 1]] = False
            stays = np.ones(len(place), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))  # one symbol less for every chunk before
            place, owner = place[stays], owner[stays]
            ranks, merged = ranks[stays], merged[stays]
            near = np.concatenate((at[at > 0] - 1, at))
            last = (near + 1 >= len(place)) | (owner[near] != owner[np.minimum(near + 1, len(place) - 1)])
            ranks[at[last[len(near) - len(at) :]]] = NEVER
            near = near[~last]
            ranks[near], merged[near] = self.pairs.find(symbols[place[near]], symbols[place[near + 1]])
        return symbols, kept

    def _merge_long(self, text: str) -> list[int]:
        """The same for one chunk, with a heap and links: time grows with its length only."""
        symbols = [self.numbers.get(character, ~ord(character)) for character in text]
        count = len(symbols)

        def rank(left: int, right: int) -> int:
            return self.ranks.get(left << 20 | right, NEVER) if left >= 0 and right >= 0 else NEVER

        following, previous = [*range(1, count), -1], [-1, *range(count - 1)]
        waiting = [
            (order, at, *pair)
            for at, pair in enumerate(zip(symbols, symbols[1:]))
            if (order := rank(*pair)) < NEVER
        ]
        heapify(waiting)
        gone = [False] * count
        while waiting:
            _, at, left, right = heappop(waiting)
            after = following[at]
            if gone[at] or after < 0 or symbols[at] != left or symbols[after] != right:
                continue
            symbols[at] = self.merged[left << 20 | right]
            gone[after] = True
            following[at] = following[after]
            if following[at] >= 0:
                previous[following[at]] = at
            for one, two in ((previous[at], at), (at, following[at])):
                if one >= 0 and two >= 0 and (order := rank(symbols[one], symbols[two])) < NEVER:
                    heappush(waiting, (order, one, symbols[one], symbols[two]))
        return [symbol for symbol, left_out in zip(symbols, gone) if not left_out]

    def encode_texts(self, texts: list[str | None]) -> Encoded:
        normalised = [self.normalise(text or "") for text in texts]
        data, starts = joined([part for part, _ in normalised])
        cuts = np.zeros(len(data), bool)
        if self.cuts_hold and len(data):
            blank = data == 0x20
            cuts[1:] = blank[1:] & ~blank[:-1]
        tokens, token_starts = self.table.gather(data, starts, cuts, 2)
        widths = tokens[:, 1].astype(np.int64)
        ends = np.cumsum(widths) - np.repeat(starts[:-1], np.diff(token_starts))
        begins = ends - widths
        for row, (_, places) in enumerate(normalised):
            own = slice(token_starts[row], token_starts[row + 1])
            if places is None:
                lag = int(self.normalise.dummy_prefix)
                begins[own] = np.maximum(begins[own] - lag, 0)
                ends[own] = np.maximum(ends[own] - lag, 0)
            else:
                begins[own], ends[own] = places[begins[own]], places[ends[own]]
        return Encoded(np.ascontiguousarray(tokens[:, 0]), begins, ends, token_starts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of any ids, in UTF-8; bytes that are none become the replacement character, one each."""
        text, offsets = self.surfaces.of(ids)
        return self.decode_taken(ids, bytes(text[offsets[0] : offsets[-1]]))

    def decode_taken(self, ids: np.ndarray, text: bytes) -> bytes:
        """``decode`` where the tokens' bytes are at hand."""
        if self.normalise.dummy_prefix or self.normalise.squeeze:
            for number in ids:  # one step, but for ids that say nothing and for models that squeeze spaces
                if self.is_byte[number]:
                    break
                surface = self.surfaces.strings[int(number)].as_py()
                if self.opens_with_space[number]:
                    text = text[1:]
                    if not self.normalise.squeeze or surface != b" ":
                        break
                elif surface:
                    break
        try:
            text.decode()
            return text
        except UnicodeDecodeError:
            return _replaced(text)


class Encoded:
    """Ids and spans of several texts in a row; text ``k`` has the tokens from ``starts[k]`` to ``starts[k + 1]``."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, starts: np.ndarray):
        self.ids, self.begins, self.ends, self.starts = ids, begins, ends, starts


def _replaced(text: bytes) -> bytes:
    """UTF-8 in which every byte that starts no character became a replacement character."""
    out, at = [], 0
    while at < len(text):
        first = text[at]
        width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        try:
            text[at : at + width].decode()
            out.append(text[at : at + width])
        except UnicodeDecodeError:
            out.append(REPLACEMENT.encode())
            width = 1
        at += width
    return b"".join(out)


class Model:
    """What a model file says, as sent to tasks; a Python worker compiles it once."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2  # reads the file's format; the work is done here

        with open(path, "rb") as file:
            content = file.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(content)
        trainer, normaliser = model.trainer_spec, model.normalizer_spec
        kinds = {piece.type for piece in model.pieces}
        if trainer.model_type != trainer.BPE or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models without user-defined or unused pieces")
        if trainer.treat_whitespace_as_suffix or not normaliser.escape_whitespaces:
            raise ValueError("only models that escape spaces and put them in front")
        if BYTE not in kinds:
            raise ValueError("only models that fall back to bytes")
        if model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only models without a denormaliser")
        self.pieces = [(piece.piece, piece.score, piece.type) for piece in model.pieces]
        self.normaliser = (
            normaliser.precompiled_charsmap, normaliser.add_dummy_prefix, normaliser.remove_extra_whitespaces
        )
        self.unknown_surface = trainer.unk_surface
        self.key = hashlib.sha256(content).digest()

    def coder(self) -> Coder:
        if self.key not in _coders:
            _coders.clear()
            _coders[self.key] = Coder(self.pieces, Normaliser(*self.normaliser), self.unknown_surface)
        return _coders[self.key]


class _Encode:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = self.model.coder()
        for batch in text_slices(batches):
            found = coder.encode_texts(batch.column("text").to_pylist())
            offsets = pa.array(found.starts, pa.int32())
            kinds = {"ids": pa.int32(), "begins": pa.int64(), "ends": pa.int64()}
            lists = [pa.ListArray.from_arrays(offsets, pa.array(getattr(found, name), kinds[name])) for name in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], ["id", *kinds])


class _Decode:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = self.model.coder()
        for batch in batches:
            lists = batch.column("ids")
            texts = [coder.decode(lists[row].values.to_numpy()).decode() for row in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])


class _Digest:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = self.model.coder()
        for batch in text_slices(batches):
            found = coder.encode_texts(batch.column("text").to_pylist())
            numbers, number_starts = coder.decimals.of(found.ids)
            text, text_starts = coder.surfaces.of(found.ids)
            spanned = np.concatenate(([0], np.cumsum(found.ends - found.begins)))
            rows = []
            for start, end in zip(found.starts[:-1].tolist(), found.starts[1:].tolist()):
                decoded = coder.decode_taken(found.ids[start:end], bytes(text[text_starts[start] : text_starts[end]]))
                rows.append((
                    end - start,
                    digest_of_numbers(numbers, number_starts[start], number_starts[end]),
                    hashlib.sha256(decoded).hexdigest(),
                    int(spanned[end] - spanned[start]),
                ))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names)


def _rows(frame: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return frame.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))


def encode(frame: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``frame``: id, ids, and begins and ends of the tokens' spans in the text's UTF-8 bytes.

    Null texts count as empty and have no ids; null ids and repeated rows stay; other columns, whatever their names, are
    not read; an empty table gives an empty result. One text must fit in a task's memory, as a row does anyway.
    """
    schema = "id long, ids array<int>, begins array<long>, ends array<long>"
    return map_batches(_rows(frame, id_column, text_column), _Encode(model), schema)


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """(id, ids) back to (id, text)."""
    return map_batches(encoded.select("id", "ids"), _Decode(model), "id long, text string")


def round_trip(frame: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass, in which ids don't leave the Python worker: id, n_tokens, ids_sha256
    (decimal ids joined by commas), decoded_sha256 and spanned_bytes, the source bytes that the tokens' spans cover."""
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spanned_bytes long"
    return map_batches(_rows(frame, id_column, text_column), _Digest(model), schema)
