"""The registered queries beside their SQL, and the pipeline beside its stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracles import compare, connect
from promolift.llm import decontaminate, exact_dedup, ngram_join, queries, sql, toxicity
from promolift.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.all_oracles()))
def test_query_equals_its_statement(spark, name):
    statement = sql.all_oracles()[name]
    assert compare(queries.all_queries()[name](spark, FOLDER), connect(FOLDER).sql(statement)) is None


@pytest.mark.parametrize("name", [name for name in queries.all_queries() if name not in sql.all_oracles()])
def test_other_queries_return_a_row_per_document(spark, name):
    found = queries.all_queries()[name](spark, FOLDER).collect()
    ids = [row.doc_id for row in table(spark, FOLDER, "documents").select("doc_id").collect()]
    assert sorted(row.doc_id for row in found) == sorted(ids)


def test_pipeline_keeps_what_its_stages_keep(spark):
    found = {row.doc_id for row in corpus_pipeline.run(spark, FOLDER).collect()}
    model, docs = queries.toxicity_model(spark, FOLDER), table(spark, FOLDER, "documents")
    texts = {row.doc_id: row.text for row in docs.collect()}
    clean = {n: text for n, text in texts.items() if model.score(text) < toxicity.THRESHOLD}
    best = {text: n for n, text in sorted(clean.items())}
    unique = docs.where(F.col("doc_id").isin(list(best.values())))
    near = ngram_join.near_copies(unique).where("component_id = id").select("id")
    windows = decontaminate.item_windows([(str(r.item_id), r.text) for r in table(spark, FOLDER, "benchmark").collect()])
    expected = set()
    for row in near.collect():
        flat = b" " + b" ".join(decontaminate.normal_words(texts[row.id])) + b" "
        if not any(window in flat for window in windows):
            expected.add(row.id)
    assert found == expected and len(corpus_pipeline.STAGES) == 5
    assert exact_dedup.keep_one(docs).columns == docs.columns


def _folder(spark, path, documents, benchmark):
    extra = "id STRING, row LONG, items STRING, component LONG, cell STRING, digest STRING, size INT"
    full = [(*row, "x", 7, "y", 1, "z", None, 3) for row in documents]
    schema = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
    spark.createDataFrame(full, f"{schema}, {extra}").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id LONG, text STRING").write.parquet(f"{path}/benchmark.parquet")
    labels = [(1, 1, 0), (2, 0, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(f"{path}/labels.parquet")
    return str(path)


LONG = "one two three four five six seven eight nine ten eleven twelve"


def test_pipeline_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", None, None, None), (2, "Alpha beta gamma delta epsilon zeta", "en", "a", 3),
        (2, "Alpha beta gamma delta epsilon zeta", "en", "a", 3), (3, "alpha BETA gamma delta epsilon zeta", "en", "a", 3),
        (4, None, "de", "b", 0), (5, "", "de", "b", 0), (6, " \n", "de", "b", 0), (None, "no id here", None, None, None),
        (None, "no id here either", None, None, None), (7, LONG, "fr", "c", 9), (8, "word " * 100_000, "fr", "c", 9),
    ]
    found = corpus_pipeline.run(spark, _folder(spark, tmp_path, rows, [(1, LONG), (None, None)])).collect()
    # Of 1, 2, 2 and 3 the exact copies leave 2 and 3, of which 2 is the least; 4 and 5 are one empty text; 7 is the item.
    assert sorted(str(row.doc_id) for row in found) == ["2", "5", "6", "8", "None", "None"]
    assert {row.doc_id: row.n_tokens for row in found}[5] == 0


@pytest.mark.parametrize("documents, benchmark", [([], [(1, LONG)]), ([(1, LONG, "en", "a", 1)], []), ([], [])])
def test_pipeline_on_empty_tables(spark, tmp_path, documents, benchmark):
    found = corpus_pipeline.run(spark, _folder(spark, tmp_path, documents, benchmark)).collect()
    assert [row.doc_id for row in found] == [row[0] for row in documents]
