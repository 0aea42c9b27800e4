from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from promolift.llm import toxicity
from promolift.llm.common import held_out, table
from tests.llm.helpers import documents

FOLDER = "/root/testdata/sf0.1"


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id LONG, toxic INT")


def test_windows_hold_the_whole_text():
    for text in ("", "a", "word " * 500, "x" * 1000, "É" * 300 + " end"):
        assert b"".join(toxicity.windows(text)) == b" " + text.lower().encode() or "É" in text
        assert sum(map(len, toxicity.windows(text))) == 1 + len(text.encode())
        assert max(map(len, toxicity.windows(text))) <= toxicity.WINDOW


def test_held_out_accuracy(spark):
    """The marks of toxic texts in other languages than English are too rare in this table to be learned from it."""
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    model = toxicity.train(docs, labels, ~held_out("doc_id"))
    assert toxicity.train(docs, labels, ~held_out("doc_id")) == model
    scored = toxicity.score(model, docs).join(labels, F.col("id") == labels.doc_id).where(held_out("doc_id"))
    counts = {(row.toxic, row.predicted): row["count"] for row in scored.groupBy("toxic", "predicted").count().collect()}
    caught = counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0))
    wrong = counts.get((0, 1), 0) / (counts[0, 0] + counts.get((0, 1), 0))
    assert caught > 0.4 and wrong < 0.01, counts


def test_small_cases(spark):
    random.seed(1)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    plain = [" ".join(random.choices(words, k=60)) for _ in range(60)]
    bad = [text + " worthless scumbag" for text in plain[:30]]
    frame = documents(spark, [*enumerate(bad + plain[30:]), (100, None), (101, ""), (None, plain[0])])
    labels = labelled(spark, [(n, int(n < 30)) for n in range(60)] + [(1, 0), (1, 0), (None, 1), (2, None)])
    model = toxicity.train(frame, labels, F.lit(True))
    scores = {row.id: row for row in toxicity.score(model, frame).collect()}
    assert len(scores) == 63
    assert sum(scores[n].score for n in range(30)) / 30 > 0.7 > 0.4 > sum(scores[n].score for n in range(30, 60)) / 30
    assert scores[100].score == scores[101].score
    assert all(row.predicted == (row.score >= 0.7) for row in scores.values())
    kept = toxicity.without_toxic(model, frame)
    assert kept.columns == frame.columns
    assert kept.count() == sum(row.predicted == 0 for row in scores.values())
    assert toxicity.score(model, frame.limit(0)).collect() == []


def test_scores_do_not_depend_on_the_samples_mix(spark, monkeypatch):
    """One text in ten is toxic, without any mark: every score is that share, however many are drawn of each side."""
    random.seed(2)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    frame = documents(spark, [(n, " ".join(random.choices(words, k=60))) for n in range(400)])
    labels = labelled(spark, [(n, int(n < 40)) for n in range(400)])
    for most in (5000, 40):
        monkeypatch.setattr(toxicity, "ORDINARY_SAMPLE", most)
        scores = [row.score for row in toxicity.score(toxicity.train(frame, labels, F.lit(True)), frame).collect()]
        assert abs(sum(scores) / len(scores) - 0.1) < 0.03, most


def test_calibration_sees_whole_texts(spark):
    random.seed(4)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(200)]

    def text(size, marks):
        own = random.choices(words, k=size)
        for place in random.sample(range(size), marks):
            own[place] = "scumbag"
        return " ".join(own)

    rows = [text(60, 4) for _ in range(60)] + [text(4000, 250) for _ in range(20)]
    rows += [text(60, 0) for _ in range(440)] + [text(4000, 2) for _ in range(40)]
    frame, labels = documents(spark, list(enumerate(rows))), labelled(spark, [(n, int(n < 80)) for n in range(560)])
    model = toxicity.train(frame, labels, F.lit(True))
    lengths = [math.log1p(len(toxicity.windows(one))) for one in rows]
    assert abs(model.center[4] - sum(lengths) / len(lengths)) < 1e-9
    fresh = [(n, text(4000, 2)) for n in range(30)] + [(n, text(4000, 250)) for n in range(30, 60)]
    found = toxicity.score(model, documents(spark, fresh)).collect()
    assert [row.id for row in found if row.predicted != (row.id >= 30)] == []


def test_nothing_to_learn(spark):
    frame = documents(spark, [(1, "a"), (2, None)])
    for labels in ([], [(1, 0)], [(1, 1), (2, 1)]):
        model = toxicity.train(frame, labelled(spark, labels), F.lit(True))
        assert [row.score for row in toxicity.score(model, frame).collect()] == [0.0, 0.0]
