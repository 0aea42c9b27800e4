"""Texts of a task as short chunks, of which every distinct one is encoded once.

Both tokenisers cut a text where no token can span, so a text's ids are its chunks' ids in a row. A slice of texts is one
buffer of bytes; its chunks are numbered by their distinct values, those are looked up or encoded, and the rest is
gathering in numpy and Arrow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
MOST_CHUNKS = 100_000
LONGEST_KEPT = 48

#: Distinct chunks to their ids, packed as int32.
Encode = Callable[[list[bytes]], list[bytes]]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of some megabytes of text, at least a row each."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all parts in one buffer, and where each part starts, with the end."""
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(part) for part in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), np.uint8), starts


class ChunkTable:
    """Encodings of chunks, packed as int32, in two generations: a full young one becomes the old one, and what is used
    again moves up, so that frequent chunks stay however many rare ones pass."""

    def __init__(self, encode: Encode, most: int = MOST_CHUNKS):
        self.encode = encode
        self.most = most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, chunks: list[bytes]) -> list[bytes]:
        """The encodings of distinct chunks."""
        young, old = self.young, self.old
        found = [young.get(chunk) or old.get(chunk) for chunk in chunks]
        missing = [place for place, packed in enumerate(found) if packed is None]
        for place, packed in zip(missing, self.encode([chunks[place] for place in missing])):
            found[place] = packed
        for chunk, packed in zip(chunks, found):
            if len(chunk) <= LONGEST_KEPT and chunk not in self.young:
                if len(self.young) >= self.most:
                    self.old, self.young = self.young, {}
                self.young[chunk] = packed
        return found

    def gather(self, data: np.ndarray, starts: np.ndarray, cuts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``width`` numbers per token of all texts, and where each text's rows start, with the end.

        ``cuts`` marks the bytes at which a chunk starts; texts start chunks of their own.
        """
        marks = np.zeros(len(data) + 1, bool)
        marks[:-1] = cuts
        marks[starts] = True
        places = np.flatnonzero(marks)
        if len(places) < 2:
            return np.zeros((0, width), np.int32), np.zeros(len(starts), np.int64)
        offsets = pa.py_buffer(places.astype(np.int32))
        chunks = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, offsets, pa.py_buffer(data)])
        numbered = chunks.dictionary_encode()
        codes = numbered.indices.to_numpy()
        packed = self.of(numbered.dictionary.to_pylist())
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // (4 * width)
        values = np.frombuffer(b"".join(packed), np.int32).reshape(-1, width)
        firsts = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        ends = np.cumsum(counts)
        rows = np.arange(ends[-1]) + np.repeat(firsts[codes] - (ends - counts), counts)
        token_starts = np.concatenate(([0], ends))[np.searchsorted(places, starts)]
        return values[rows], token_starts


class Written:
    """Strings by number, and the concatenation of those that ids name, without a Python object per id."""

    def __init__(self, strings: list[bytes]):
        self.strings = pa.array(strings, pa.large_binary())

    def of(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes in a row, and where each id's bytes start, with the end."""
        taken = self.strings.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1]
        return memoryview(taken.buffers()[2] or b""), offsets


def decimals(most: int) -> Written:
    """Every number up to ``most`` with a comma behind it."""
    return Written([b"%d," % number for number in range(most + 1)])


def digest_of_numbers(text: memoryview, start: int, end: int) -> str:
    """SHA-256 of comma-joined numbers; each has a comma behind it in ``text``."""
    return hashlib.sha256(text[start : max(start, end - 1)]).hexdigest()
