from __future__ import annotations

import random
import re
import time

import pyarrow as pa
import pytest

from promolift.llm import decontaminate
from tests.llm.helpers import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, other in items:
        parts = words(other)
        size = min(10, len(parts))
        for start in range(len(parts) - size + 1) if parts else ():
            for at in range(len(own) - size + 1):
                if own[at : at + size] == parts[start : start + size]:
                    hit.update(range(at, at + size))
                    found.add("" if item is None else str(item))
    return len(own), len(hit), sorted(found)


def bench(spark, items):
    return spark.createDataFrame([(*item, "x", 1) for item in items], "item_id LONG, text STRING, id STRING, n_hit INT")


def test_long_items_are_cut_into_pieces_with_all_windows(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    text = " ".join(f"w{n % 23} é" for n in range(40))
    for part in (text, " ".join(text.split()[:10]), " ".join(text.split()[:16]), "one two", ""):
        batch = pa.RecordBatch.from_pydict({"id": ["a"], "text": [part]})
        found = [piece.to_pylist() for piece in decontaminate._pieces([batch])]
        pieces = [(row["id"], row["text"]) for rows in found for row in rows]
        assert decontaminate.item_windows(pieces) == decontaminate.item_windows([("a", part)])


@pytest.mark.parametrize("part_bytes, piece_words", [(1 << 20, 4096), (60, 3), (25, 4096)])
def test_against_brute_force(spark, monkeypatch, part_bytes, piece_words):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece_words)
    random.seed(7)
    vocabulary = ["a", "B", "é", "É", "x1", "ß", "日本", "to", "be"]
    line = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(n, line(random.choice([1, 3, 12, 25]))) for n in range(12)] + [(None, line(9)), (3, line(14)), (20, None), (21, "?!")]
    rows = [(n, random.choice(["", " -- ", "\n"]).join([line(8), random.choice(items)[1] or "", line(5)])) for n in range(40)]
    rows += [(50, None), (51, ""), (52, "... !"), (None, items[0][1]), (53, items[5][1].upper().replace(" ", "_"))]
    frame, benchmark = documents(spark, rows), bench(spark, items)
    found = decontaminate.contamination(frame, benchmark).collect()
    expected = {(number, brute(text, items)[0], brute(text, items)[1], tuple(brute(text, items)[2])) for number, text in rows}
    assert {(row.id, row.n_words, row.n_hit, tuple(row["items"])) for row in found} == expected
    by_id = dict(rows)
    for row in found:
        if row.id is not None:
            own = [by_id[row.id][span.start : span.end] for span in row.spans]
            assert sum(len(words(part)) for part in own) == row.n_hit == sum(len(words(part)) for part in own)
    assert len(list(decontaminate.scanners(benchmark))) > 4 or part_bytes > 60
    kept = decontaminate.without_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(map(str, (row.doc_id for row in kept.collect()))) == sorted(str(row.id) for row in found if not row.contaminated)


def test_empty_tables(spark):
    frame, none = documents(spark, [(1, "a b c")]), bench(spark, [(1, None)])
    assert [row.n_hit for row in decontaminate.contamination(frame, none).collect()] == [0]
    assert decontaminate.contamination(frame.limit(0), none).collect() == []
    assert decontaminate.contamination(frame, none.limit(0)).first().n_words == 3
    assert decontaminate.without_contaminated(frame, none.limit(0)).count() == 1
    assert decontaminate.without_contaminated(frame.limit(0), bench(spark, [(1, "a b c")])).count() == 0


def test_very_long_texts(spark):
    random.seed(9)
    text = " ".join(random.choice("abcdefgh") * random.randint(1, 3) for _ in range(150_000))
    planted = " ".join(f"q{n}" for n in range(30))
    frame = documents(spark, [(1, text), (2, text + " " + planted + " " + text)])
    found = {row.id: row for row in decontaminate.contamination(frame, bench(spark, [(5, "zz " + planted)])).collect()}
    assert (found[1].n_hit, found[1].n_words) == (0, 150_000)
    assert (found[2].n_hit, found[2].n_words, list(found[2]["items"])) == (30, 300_030, ["5"])


def test_a_large_benchmark_scans_as_fast_as_a_small_one():
    random.seed(3)
    words = [f"w{n}" for n in range(20_000)]
    items = [(str(n), " ".join(random.choices(words, k=500))) for n in range(470)]  # 230,000 windows, 1.5 MB
    scanner = decontaminate.Scanner(items)
    other = words[::5] + [f"v{n}" for n in range(16_000)]  # one word in five is one of the benchmark
    texts = [" ".join(random.choices(other, k=300)) for _ in range(511)] + [items[7][1]]
    slice_of = [decontaminate.normal_words(text) for text in texts]
    scanner.occurrences(slice_of[0])
    start = time.process_time()
    found = [scanner.occurrences(text) for text in slice_of]
    assert time.process_time() - start < 0.5 and len(found[-1]) == 491 and not any(found[:-1])
