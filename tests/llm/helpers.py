"""Small tables, and a shared folder for them."""

from __future__ import annotations

DOCUMENTS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def documents(spark, rows):
    """Rows of (doc_id, text); columns that clash with names used inside, and nulls, come along."""
    full = [(number, text, None, None, None, "x", None, 7, "y") for number, text in rows]
    extra = ", id STRING, component STRING, digest INT, _digest STRING"
    return spark.createDataFrame(full, DOCUMENTS + extra).repartition(3)


def rows(frame, *names):
    order = lambda row: tuple((value is None, str(type(value)), value if value is not None else 0) for value in row)
    return sorted((tuple(row[name] for name in names) for row in frame.collect()), key=order)
