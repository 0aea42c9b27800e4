"""Distinct word shingles of whole texts as 64-bit hashes, computed on byte buffers in bulk.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR, with A-Z lower-cased. A shingle is ``WIDTH``
consecutive words; a text of fewer words, but not none, is one shingle. A word's hash is a polynomial over its bytes,
taken from one running sum over the buffer, so that no Python object is made per word.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
PIECE_BYTES = 1 << 20

_LOWER = bytes(byte + 32 if 65 <= byte <= 90 else byte for byte in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _RANDOM.integers(1, 1 << 64, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 1 << 64, WIDTH, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RANDOM.integers(1, 1 << 62)) * 4 + 3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the splitmix64 finaliser)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _power(base: int, length: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < length:
        factors = np.full(max(length, PIECE_BYTES + 1), base & ((1 << 64) - 1), np.uint64)
        factors[0] = 1
        known = _powers[base] = np.multiply.accumulate(factors)
    return known[:length]


def _piece_hashes(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a piece that ends in white space."""
    codes = np.frombuffer(piece, np.uint8)
    space = _SPACE[codes]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    first, last = edge[0::2], edge[1::2]
    running = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[codes] * _power(_BASE, len(codes)), out=running[1:])
    hashes = (running[last] - running[first]) * _power(_BASE_INVERSE, len(codes))[first]
    if len(codes) > 4 * PIECE_BYTES:
        _powers.clear()
    return mixed(hashes), first


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word, piece by piece, so memory follows the piece and not the text."""
    data = data.translate(_LOWER) + b" "
    hashes, firsts, start = [], [], 0
    while start < len(data):
        stop = min(start + PIECE_BYTES, len(data))
        while stop < len(data) and not _SPACE[data[stop - 1]]:
            ends = [at for at in (data.find(mark, stop) for mark in (b" ", b"\n")) if at >= 0]
            stop = min(ends) + 1
        found, first = _piece_hashes(data[start:stop])
        hashes.append(found)
        firsts.append(first + start)
        start = stop
    return np.concatenate(hashes), np.concatenate(firsts)


def _combined(words: np.ndarray, width: int) -> np.ndarray:
    count = len(words) - width + 1
    total = np.full(count, width, np.uint64)
    for place in range(width):
        total += words[place : place + count] * _PLACE[place]
    return mixed(total)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Per text its distinct shingle hashes, ascending; none for null and for texts without words."""
    out: list[np.ndarray] = []
    batch: list[bytes] = []
    size = 0
    for text in texts:
        batch.append((text or "").encode())
        size += len(batch[-1])
        if size >= PIECE_BYTES:
            out += _sets(batch)
            batch, size = [], 0
    return out + _sets(batch)


def _sets(batch: list[bytes]) -> list[np.ndarray]:
    if not batch:
        return []
    words, first = word_hashes(b"\n".join(batch))
    lengths = np.fromiter((len(data) + 1 for data in batch), np.int64, len(batch))
    cut = np.searchsorted(first, np.concatenate(([0], np.cumsum(lengths))))
    shingles = _combined(words, WIDTH) if len(words) >= WIDTH else words[:0]
    out = []
    for start, stop in zip(cut[:-1], cut[1:]):
        if stop - start >= WIDTH:
            out.append(np.unique(shingles[start : stop - WIDTH + 1]))
        elif stop > start:
            out.append(_combined(words[start:stop], stop - start))
        else:
            out.append(words[:0])
    return out
