"""Benchmark passages in documents: one Aho-Corasick automaton over normalised items, each text scanned once.

Normalising lower-cases A-Z and turns every run of other ASCII bytes than digits and letters into one space; all other
characters are kept. An item's windows are its runs of ``WINDOW`` consecutive words; an item of fewer words, but not
none, is one window. All windows, with a space at both ends, are the automaton's patterns. Words inside any occurrence
are hit; an occurrence's offsets are mapped back to the original text.

The automaton reads words: each word of the benchmark is spelled as its number in three letters, all others alike. It travels to every task with
the items it is made of, so a benchmark of any size is dealt into parts of about ``PART_BYTES``, long items cut into
overlapping pieces, and written to the shared folder. Documents are scanned once per part, with one automaton at a time;
hit words and items of all parts are united for each document before they are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import map_batches, slices, staged

WINDOW = 10
PART_BYTES = 1 << 20  # some 170 MB as an automaton
PIECE_WORDS = 4096
LETTERS, BASE_BITS = 3, 7  # more words than a part of PART_BYTES can have

_NORMAL = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte >= 128 else 32
    for byte in range(256)
)
_OTHER = "\0" * LETTERS
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_IN_PART = "row long, items array<string>, runs array<struct<start: int, end: int>>"
_FOUND = (
    "id long, n_words long, n_hit long, items array<string>, contaminated boolean, "
    "spans array<struct<start: int, end: int>>"
)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def item_windows(items: list[tuple[str, str]]) -> dict[bytes, list[str]]:
    """Window to the ids of the items that have it."""
    windows: dict[bytes, set[str]] = {}
    for item, text in items:
        words = normal_words(text)
        for start in range(max(1, len(words) - WINDOW + 1) if words else 0):
            windows.setdefault(b" " + b" ".join(words[start : start + WINDOW]) + b" ", set()).add(item)
    return {window: sorted(windows[window]) for window in sorted(windows)}


class Scanner:
    """Occurrences of the windows in texts; sent to tasks with the items only, the automaton is built there."""

    def __init__(self, items: list[tuple[str, str]]):
        self.items = tuple(items)

    def occurrences(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(first word, word after the last, items) of each occurrence in a normalised text."""
        spelled, automaton = _automaton(self.items)
        if not spelled:
            return []
        read = "".join([spelled.get(word, _OTHER) for word in words])
        found = ((last // LETTERS + 1, size, ids) for last, (size, ids) in automaton.iter(read))
        return [(end - size, end, ids) for end, size, ids in found]


def _spelling(number: int) -> str:
    """A word's number in LETTERS letters, those of each place from an alphabet of its own, so that occurrences start
    at words. Nodes of the automaton have few branches."""
    digits = (number >> BASE_BITS * place & (1 << BASE_BITS) - 1 for place in range(LETTERS))
    return "".join(chr(1 + (place << BASE_BITS) + digit) for place, digit in enumerate(digits))


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[str, str], ...]) -> tuple[dict[bytes, str], ahocorasick.Automaton]:
    spelled: dict[bytes, str] = {}
    automaton = ahocorasick.Automaton()
    for window, ids in item_windows(list(items)).items():
        words = window.split()
        pattern = "".join([spelled.get(word) or spelled.setdefault(word, _spelling(len(spelled))) for word in words])
        automaton.add_word(pattern, (len(words), ids))
    if spelled:
        automaton.make_automaton()
    return spelled, automaton


def runs_of(occurrences: list[tuple[int, int, list[str]]]) -> list[tuple[int, int]]:
    """The hit words of occurrences, or of runs, as runs that neither meet nor overlap."""
    runs: list[tuple[int, int]] = []
    for start, end, *_ in sorted(occurrences, key=lambda found: found[:2]):
        if runs and start <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(end, runs[-1][1])
        else:
            runs.append((start, end))
    return runs


def spans_of(text: str | None, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words in code points of the original text."""
    places = [match.span() for match in _WORD.finditer(text or "")] if runs else []
    return [{"start": places[start][0], "end": places[end - 1][1]} for start, end in runs]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _row(number: int | None, text: str | None, n_words: int, items: list[str], runs: list[tuple[int, int]]) -> tuple:
    n_hit = sum(end - start for start, end in runs)
    return number, n_words, n_hit, items, n_hit > 0, spans_of(text, runs)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.list_(pa.string()), pa.bool_(), _SPANS]
    names = ["id", "n_words", "n_hit", "items", "contaminated", "spans"]
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)], names)


def _items_of(occurrences: list[tuple[int, int, list[str]]]) -> list[str]:
    return sorted({item for _, _, ids in occurrences for item in ids})


class _Find:
    def __init__(self, scanner: Scanner):
        self.scanner = scanner

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for number, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = normal_words(text)
                found = self.scanner.occurrences(words)
                rows.append(_row(number, text, len(words), _items_of(found), runs_of(found)))
            yield _found(rows)


class _FindInPart:
    """Items and runs of the rows that one part of the benchmark hits."""

    def __init__(self, scanner: Scanner):
        self.scanner = scanner

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                if found := self.scanner.occurrences(normal_words(text)):
                    runs = [{"start": start, "end": end} for start, end in runs_of(found)]
                    rows.append({"row": row, "items": _items_of(found), "runs": runs})
            kinds = [("row", pa.int64()), ("items", pa.list_(pa.string())), ("runs", _SPANS)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with what the parts found in them, as lists of lists, to the result."""
    for batch in slices(batches):
        rows = []
        for row in batch.to_pylist():
            items = sorted({item for found in row["items"] or () for item in found})
            runs = runs_of([(run["start"], run["end"]) for found in row["runs"] or () for run in found])
            rows.append(_row(row["id"], row["text"], len(normal_words(row["text"])), items, runs))
        yield _found(rows)


class _Drop:
    def __init__(self, scanner: Scanner, text_column: str):
        self.scanner, self.text_column = scanner, text_column

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(self.text_column).to_pylist()
            yield batch.filter(pa.array([not self.scanner.occurrences(normal_words(text)) for text in texts], pa.bool_()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items to pieces of normal words with all their windows, each window in one piece."""
    for batch in slices(batches, 64):
        rows = []
        for item, text in zip(*(batch.column(name).to_pylist() for name in ("id", "text"))):
            words = normal_words(text)
            for start in range(0, max(1, len(words) - WINDOW + 1) if words else 0, PIECE_WORDS):
                rows.append((item, b" ".join(words[start : start + PIECE_WORDS + WINDOW - 1]).decode()))
        columns = [pa.array([row[k] for row in rows], pa.string()) for k in range(2)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "text"])


def scanners(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[Scanner]:
    """One scanner for each part of the benchmark. A null id counts as the empty id; a null text has no words."""
    item = F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id")
    pieces = map_batches(benchmark.select(item, F.col(text_column).alias("text")), _pieces, "id string, text string")
    pieces = staged(pieces.distinct(), "benchmark")
    size = pieces.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = 1 + size // PART_BYTES
    for part in range(parts):
        own = pieces.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        yield Scanner(sorted((row.id, row.text) for row in own.collect()))


def contamination(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document row: id, n_words, n_hit, items (sorted as strings), contaminated, spans.

    ``spans`` are maximal runs of hit words in code points of the original text, end exclusive. Null, empty and
    wordless texts have no words and no hits; repeated items and rows count as they stand; extra columns of either
    table, whatever their names, are not read; an empty benchmark hits nothing.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    parts = scanners(benchmark)
    first, second = next(parts), next(parts, None)
    if second is None:
        return map_batches(rows, _Find(first), _FOUND)
    numbered = staged(rows.withColumn("row", F.monotonically_increasing_id()), "scanned")
    found = [
        staged(map_batches(numbered.select("row", "text"), _FindInPart(part), _IN_PART), "hits")
        for part in chain((first, second), parts)
    ]
    by_row = reduce(DataFrame.unionAll, found).groupBy("row")
    by_row = by_row.agg(*[F.collect_list(name).alias(name) for name in ("items", "runs")])
    return map_batches(numbered.join(by_row, "row", "left").drop("row"), _united, _FOUND)


def without_contaminated(documents: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` in whose text no window occurs, with all their columns.

    Rows without words stay, null texts and ids included; repeated rows stay or go alike; an empty benchmark drops
    nothing and an empty table stays empty. With several parts, each scans what those before have left.
    """
    kept = documents
    for place, part in enumerate(scanners(benchmark)):
        kept = map_batches(staged(kept, "scanned") if place else kept, _Drop(part, text_column), documents.schema)
    return kept
