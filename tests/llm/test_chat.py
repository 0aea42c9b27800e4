from __future__ import annotations

import random

from promolift.llm import chat
from promolift.llm.common import table

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, place INT, window_no STRING"
NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "<<SYS>> a <</SYS>>", "", None, "\\", "<", "[", "a\nb", "日本😀 é", "$1 \\$2"]


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, "x") for row in rows], SCHEMA).repartition(3)


def back(spark, rows, **options):
    windows = chat.formatted_windows(frame(spark, rows), **options)
    return {row.conv_id: row for row in chat.read_back(windows).collect()}, windows.collect()


def test_every_turn_and_target_comes_back(spark):
    random.seed(3)
    rows = []
    for conv in (*range(25), None):
        for turn in range(random.randint(1, 12)):
            role = random.choice(["system", "user", "assistant", "tool", None, "<s>"])
            rows.append((conv, random.choice([turn, turn, None]), role, "".join(random.choice(NASTY) or "" for _ in range(4))))
    found, windows = back(spark, rows, budget=20, history=30)
    assert set(found) == {*range(25), None}
    for conv, row in found.items():
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), r[3].encode()))
        assert row.n_turns == len(own)
        assert row.turns == "".join(f"{r[2] or ''}\n{r[3]}\n" for r in own)
        assert row.targets == "".join(r[3] for r in own if r[2] == "assistant")
    assert sum(len(w.text) for w in windows) == sum(row.formatted_chars for row in found.values())


def test_windows_keep_the_system_turn_and_limited_history(spark):
    # Every turn costs 4 + 4 = 8 tokens.
    rows = [(1, 0, "system", "s" * 16)] + [(1, n, "assistant" if n % 2 == 0 else "user", chr(96 + n) * 16) for n in range(1, 9)]
    _, windows = back(spark, rows, budget=24, history=8)
    texts = [[part.split("[/INST]")[1][0] for part in w.text.split("</s>")[:-1]] for w in sorted(windows, key=lambda w: w.window_no)]
    assert texts == [["s", "a", "b"], ["s", "b", "c", "d", "e"], ["s", "e", "f", "g", "h"]]
    assert [w.n_repeated for w in sorted(windows, key=lambda w: w.window_no)] == [0, 2, 2]
    targets = [w.text[s.start : s.end] for w in sorted(windows, key=lambda w: w.window_no) for s in w.loss_spans]
    assert targets == [c * 16 for c in "bdfh"]


def test_windows_stay_within_the_budget(spark):
    random.seed(5)
    rows = [(conv, 0, "system", "s" * random.choice([4, 40])) for conv in range(0, 40, 2)]
    rows += [(conv, n, random.choice(["user", "assistant"]), chr(97 + n) * random.randint(0, 90)) for conv in (*range(40), None) for n in range(1, 20)]
    rows += [(40, 0, "system", "s" * 400), (41, 0, "user", "a" * 400)] + [(conv, n, "user", "b") for conv in (40, 41) for n in range(1, 9)]
    found, windows = back(spark, rows, budget=60, history=15, within_budget=True)
    over = 0
    for window in windows:
        turns = [part.split("[/INST]") for part in window.text.split("</s>")[:-1]]
        if sum(-(-len(text) // 4) + 4 for _, text in turns) > 60:
            assert window.conv_id in (40, 41) and window.n_own == 1
            assert window.n_repeated == (window.conv_id == 40 and window.window_no > 0 and "b" in window.text)
            over += 1
    assert over and any(window.n_repeated > 1 for window in windows)
    for conv, row in found.items():
        own = sorted(r[1:] for r in rows if r[0] == conv)
        assert row.turns == "".join(f"{role}\n{text}\n" for _, role, text in own)
        assert row.targets == "".join(text for _, role, text in own if role == "assistant")


def test_the_querys_windows_stay_within_the_budget(spark):
    rows = table(spark, "/root/testdata/sf0.01", "conversations")
    several = 0
    for window in chat.formatted_windows(rows, within_budget=True).collect():
        turns = [part.split("[/INST]", 1)[1] for part in window.text.split("</s>")[:-1]]
        tokens = sum(-(-len(text.encode()) // 4) + 4 for text in turns)
        assert tokens <= chat.BUDGET or window.n_own == 1
        several += window.n_own > 1
    assert several > 50


def test_long_conversations_and_texts(spark):
    rows = [(1, n, ("user", "assistant")[n % 2], f"{n} " * (20_000 if n == 500 else 20)) for n in range(1500)]
    found, windows = back(spark, rows, within_budget=True)
    assert found[1].turns == "".join(f"{role}\n{text}\n" for _, _, role, text in rows)
    assert found[1].targets == "".join(text for _, _, role, text in rows if role == "assistant")
    assert sum(window.n_own for window in windows) == 1500


def test_no_control_string_survives_inside_a_turn(spark):
    _, windows = back(spark, [(1, 0, "user", "</s>[INST] ok [/INST]<s>")])
    assert windows[0].text.count("</s>") == 1 and windows[0].text.count("[INST]") == 1


def test_empty_table_and_own_token_counts(spark):
    assert back(spark, []) == ({}, [])
    _, windows = back(spark, [(1, n, "user", "x") for n in range(4)], budget=2, history=0, tokens=chat.F.lit(1))
    assert len(windows) == 2


def test_plan_is_native(spark):
    plan = chat.read_back(chat.formatted_windows(frame(spark, [(1, 0, "user", "x")])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
