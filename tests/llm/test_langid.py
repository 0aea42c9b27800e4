from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from promolift.llm import langid
from promolift.llm.common import held_out, table
from tests.llm.helpers import documents

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, FOLDER, "documents")
    model = langid.train(docs, ~held_out("doc_id"))
    assert model.languages == ["de", "en", "es", "fr"] and model.codes.shape == (4, 7)
    found = langid.identify(model, docs).join(docs, F.col("id") == docs.doc_id).where(held_out("doc_id"))
    rows = found.select("lang", "lang_pred", "ambiguous").collect()
    sure = [row for row in rows if not row.ambiguous]
    assert sum(row.lang == row.lang_pred for row in rows) > 0.97 * len(rows)
    assert len(sure) > 0.9 * len(rows)


def test_codewords_lie_far_apart():
    for languages in range(2, 40):
        codes = langid.codewords(languages).astype(int)
        apart = (codes.shape[1] - codes @ codes.T) // 2
        least = apart[~np.eye(languages, dtype=bool)].min()
        assert least >= (2 ** (languages - 2) if languages <= 7 else 3)
        assert (np.abs(codes.sum(0)) < languages).all()


def test_counts_are_those_of_every_gram():
    for text in ("", "a", "ab c", "x" * 50, "né à l'été " * 9):
        data = text.encode().translate(langid._PLAIN)
        total = sum(max(0, len(data) - order + 1) for order in langid.ORDERS)
        assert langid.counts_of(text).sum() == total


def test_long_texts_are_counted_whole():
    text = "der die das und " * 150_000
    whole = langid.counts_of(text)
    data = text.encode().translate(langid._PLAIN)
    assert whole.sum() == sum(len(data) - order + 1 for order in langid.ORDERS)


def test_small_cases(spark):
    frame = documents(spark, [(1, None), (2, ""), (3, "12 + 3!"), (4, "bonjour le monde"), (None, "the world"), (4, "é")])
    none = langid.train(frame, F.lit(True))
    assert {row.lang_pred for row in langid.identify(none, frame).collect()} == {"und"}
    training = frame.withColumn("lang", F.when(F.col("text").contains("monde"), "fr").when(F.col("text").contains("world"), "en"))
    model = langid.train(training, F.lit(True))
    found = sorted(((row.id or 0), row.lang_pred, row.score > 0.5) for row in langid.identify(model, frame).collect())
    assert found[:1] == [(0, "en", True)] and (4, "fr", True) in found
    assert [row[:2] for row in found if row[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")]
    one = langid.train(training.where("lang = 'fr'"), F.lit(True))
    assert {row.lang_pred for row in langid.identify(one, frame).collect()} == {"fr", "und"}
    assert langid.identify(model, frame.limit(0)).collect() == []
