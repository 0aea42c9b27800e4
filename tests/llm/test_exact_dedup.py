from __future__ import annotations

import hashlib
import random

import pytest

from promolift.llm import exact_dedup
from tests.llm.helpers import documents

GIVEN = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (None, "a"), (None, "c"), (None, "c"), (6, "x" * 100_000)]


def check(rows, found):
    groups = {}
    for number, text in rows:
        groups.setdefault(text or "", []).append(number)
    assert len(found) == len(rows)
    for row in found:
        text = next(text for text in groups if hashlib.sha256(text.encode()).hexdigest() == row.text_sha256)
        own = groups[text]
        best = max((n for n in own if n is not None), default=None)
        assert (row.keep_id, row.group_size) == (best, len(own))
        assert not row.kept or row.id == best
    kept = [row.text_sha256 for row in found if row.kept]
    assert len(kept) == len(set(kept)) == len(groups)


@pytest.mark.parametrize("heavy, tracked", [(1, 1), (2, 8), (1000, 20_000)])
def test_one_row_of_each_text_is_kept(spark, heavy, tracked):
    random.seed(5)
    rows = GIVEN + [(random.randint(10, 400), random.choice(["hot", "hot", f"t{n % 90}"])) for n in range(300)]
    frame = documents(spark, rows)
    check(rows, exact_dedup.exact_copies(frame, heavy=heavy, tracked=tracked).collect())
    kept = exact_dedup.keep_one(frame, heavy=heavy, tracked=tracked)
    assert kept.columns == frame.columns
    best = {}
    for number, text in rows:
        best[text or ""] = max(best.get(text or "", -1), -1 if number is None else number)
    assert sorted((row.text or "", -1 if row.doc_id is None else row.doc_id) for row in kept.collect()) == sorted(best.items())


def test_empty_table(spark):
    frame = documents(spark, GIVEN).limit(0)
    assert exact_dedup.exact_copies(frame).collect() == [] and exact_dedup.keep_one(frame).collect() == []


def test_plan_is_native(spark):
    for frame in (exact_dedup.exact_copies(documents(spark, GIVEN)), exact_dedup.keep_one(documents(spark, GIVEN))):
        plan = frame._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
