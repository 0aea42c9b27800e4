from __future__ import annotations

import hashlib
import heapq
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promolift.llm import repair as module
from promolift.llm.repair import FINAL, INITIALS, START, repair, transcripts, walk
from tests.llm.helpers import rows as rows_of

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, row STRING, edit INT, letter STRING, partition STRING"
GOAL = re.compile("(s?(ua)+)?")
BLANK = re.compile("[\x20\x09-\x0d]")


def faults(rows):
    """First fault of each row of a conversation, in order."""
    seen, out = set(), []
    for role, text in rows:
        visible = BLANK.sub("", text)
        fault = "" if visible[-1:] in (".", "!", "?") and visible else "truncated"
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else fault
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows):
    """Cost, letters and rows of the cheapest edits with the least letters: all edits in order of cost and letters."""
    found = faults(rows)
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, letters, at, roles, kept = heapq.heappop(queue)
        if at == len(rows) and GOAL.fullmatch(roles):
            return cost, letters, list(kept)
        state = at, roles[-1:]
        if state in done:
            continue
        done.add(state)
        steps = [(2, "I", role[0], ((role, ""),)) for role in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            steps.append((3, "D", "", ()))
            if found[at] not in ("blank", "duplicate"):
                extra = found[at] == "truncated"
                steps.append((extra, "K", role[:1] or "?", ((role, text),)))
                steps += [(2 + extra, "R", new[0], ((new, text),)) for new in ("user", "assistant")]
        for price, letter, initial, rest in steps:
            if re.fullmatch("s?(ua)*u?", roles + initial):
                now = cost + price, letters + letter, at + (letter != "I"), roles + initial, kept + rest
                heapq.heappush(queue, now)
    raise AssertionError


def letters_of(rows):
    names = list(module.FAULTS)
    return "".join(
        chr(module.LETTER + 4 * (INITIALS[:3].find(role[:1]) if role[:1] and role[0] in "sua" else 3) + names.index(fault))
        for (role, _), fault in zip(rows, faults(rows))
    )


ROWS = st.lists(
    st.tuples(
        st.sampled_from(["system", "user", "assistant", "tool", "", "s", "unknown"]),
        st.sampled_from(["", " \n", "Yes.", "No", "Why?", "Go! ", " "]),
    ),
    max_size=9,
)


def expected(rows):
    cost, audit, kept = cheapest(rows)
    found = faults(rows)
    legal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{role}:{text}" for role, text in kept)
    counts = [found.count(name) for name in ("blank", "duplicate", "truncated")]
    return (*counts, legal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_edits_are_the_cheapest_and_least(rows):
    if not rows:
        return
    cost, audit, _ = cheapest(rows)
    letters = letters_of(rows)
    edits, _ = walk(letters, START, FINAL, True)
    assert "".join(edit.letters for edit in edits) == audit
    assert module.before_run(letters, FINAL)[START] == cost


@settings(max_examples=200, deadline=None)
@given(ROWS, st.integers(1, 8), st.integers(1, 8))
def test_runs_join_to_the_same_edits(rows, first, second):
    letters = letters_of(rows)
    parts = [part for part in (letters[:first], letters[first : first + second], letters[first + second :]) if part]
    if not parts:
        return
    after = [FINAL]
    for part in reversed(parts[1:]):
        after.insert(0, module.joined_with(module.run_matrix(part), after[0]))
    state, audit = START, ""
    for place, part in enumerate(parts):
        edits, state = walk(part, state, after[place], place == len(parts) - 1)
        audit += "".join(edit.letters for edit in edits)
    assert audit == "".join(edit.letters for edit in walk(letters, START, FINAL, True)[0])


def test_long_conversations_are_walked_from_checkpoints():
    letters = "".join("BFJENDHACL"[k * 7 % 10] for k in range(2500))
    vectors = [module.before_run(letters[at:], FINAL) for at in (0, 1000)]
    edits, state = walk(letters, START, FINAL, True)
    assert state in (0, 3) and len(edits) == 2500 and vectors[0][START] > vectors[1][START]
    spent = sum(
        {"D": 3, "R": 2, "I": 2, "K": 0}[letter] for edit in edits for letter in edit.letters
    ) + sum(edit.letters.rstrip("I")[-1] != "D" and letters[edit.row] in "DHLP" for edit in edits)
    assert spent == vectors[0][START]


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", 7, None, "y") for row in rows], SCHEMA)


def check(spark, conversations, result):
    by_id = {}
    for conv, turn, role, text in conversations:
        by_id.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = set()
    for conv, own in by_id.items():
        ordered = sorted(own, key=lambda row: (row[0] is not None, row[0] or 0, row[1] + "\0" + row[2]))
        turns = {row[0] for row in own if row[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        want.add((conv, gaps, *expected([row[1:] for row in ordered])))
    summary, letters = result.summary, transcripts(result.steps).withColumnRenamed("conv_id", "of")
    joined = summary.join(letters, summary.conv_id.eqNullSafe(letters.of))
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert {tuple(row[name] for name in names) for row in joined.collect()} == want


def random_rows(count, conversations, seed=1):
    import random

    random.seed(seed)
    roles, texts = ["system", "user", "assistant", None, "tool", ""], ["", "Yes.", "No", "Why?", None, "Fine. \n"]
    return [
        (random.choice(conversations), random.choice([None, 0, 1, 2, 5, 9]), random.choice(roles), random.choice(texts))
        for _ in range(count)
    ]


def test_conversations_with_nulls_ties_repeats_and_clashing_columns(spark):
    given_rows = random_rows(300, [None, *range(40)])
    check(spark, given_rows, repair(frame(spark, given_rows)))


def test_one_conversation_over_many_partitions(spark):
    rows = [(7, turn, ("user", "assistant")[turn * turn % 3 % 2], f"{turn % 37} words" + ".!"[turn % 2 :]) for turn in range(60)]
    rows += random_rows(60, [3, 7, 8], seed=2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        result = repair(frame(spark, rows).repartition(5))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert result.steps.where("conv_id = 7").selectExpr("count(distinct shiftright(row, 33))").first()[0] > 1
    check(spark, rows, result)


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "a " * 500_000), (1, 1, "assistant", " " * 500_000), (1, 2, "assistant", "b" * 500_000 + ".")]
    check(spark, rows, repair(frame(spark, rows)))


def test_no_rows(spark):
    result = repair(frame(spark, []))
    assert result.summary.count() == 0 and transcripts(result.steps).count() == 0


@pytest.mark.parametrize("text, audit", [("x.", "KI"), ("", "D"), ("x", "D")])
def test_one_row(spark, text, audit):
    result = repair(frame(spark, [(1, 0, "user", text)]))
    assert rows_of(transcripts(result.steps), "audit") == [(audit,)]
