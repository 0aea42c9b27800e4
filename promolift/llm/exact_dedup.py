"""Exact copies by a heavy-hitter split. DataFrame work only.

Texts are equal when their bytes are; null counts as the empty text. Of equal texts the row with the largest id stays,
a null id counting as the smallest; of rows that are equal in id and text one stays, and which one is left open.

Digests go to a written table once. A mergeable Misra-Gries sketch per task (Spark's ``approx_top_k``) names up to
``HEAVY`` digests that may be frequent, in memory bounded by ``TRACKED`` counters. Their exact counts and winners are
verified by partial aggregates, so these rows never meet in one task; at most HEAVY winners are broadcast, and all
other rows of the digest are decided where they are. The remaining digests, none of which holds more than about
4 / TRACKED of all rows, are shuffled and decided by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolift.llm.common import staged

HEAVY = 1000
TRACKED = 20_000


def _digest(text_column: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_column).cast("string"), F.lit("")), 256)


def _digests(frame: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = frame.select(F.col(id_column).alias("id"), _digest(text_column).alias("digest"))
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def _summary() -> list[Column]:
    return [F.max(F.struct("id", "row")).alias("winner"), F.count("*").alias("group_size")]


def heavy_winners(rows: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """(digest, winner, group_size) of the sketch's frequent digests, exact; at most ``heavy`` rows."""
    named = rows.agg(F.expr(f"approx_top_k(digest, {heavy}, {max(heavy, tracked)})").alias("found"))
    candidates = named.select(F.explode("found.item").alias("digest"))
    counted = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*_summary())
    return staged(counted.where("group_size > 1"), "heavy")


def exact_copies(
    frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", heavy: int = HEAVY, tracked: int = TRACKED
) -> DataFrame:
    """One row per row of ``frame``: id, keep_id, group_size, kept and text_sha256.

    Empty and null texts form one group. Extra columns, whatever their names, are not read; an empty table gives an
    empty result.
    """
    rows = _digests(frame, id_column, text_column)
    winners = heavy_winners(rows, heavy, tracked)
    frequent = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest",
        "id",
        "row",
        F.max(F.struct("id", "row")).over(group).alias("winner"),
        F.count("*").over(group).alias("group_size"),
    )
    return frequent.unionByName(rest).select(
        "id",
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("winner.row") == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(
    frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", heavy: int = HEAVY, tracked: int = TRACKED
) -> DataFrame:
    """The rows of ``frame`` that stay, with all their columns.

    Losers of frequent digests are dropped before any text is shuffled.
    """
    rows = _digests(frame, id_column, text_column)
    winners = heavy_winners(rows, heavy, tracked)
    slim = winners.select(F.col("digest").alias("_digest"), F.col("winner.id").alias("_keep"))
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    best = light.groupBy(F.col("digest").alias("_digest")).agg(F.max("id").alias("_keep"))
    marked = frame.withColumn("_digest", _digest(text_column))
    stays = F.col(id_column).eqNullSafe(F.col("_keep"))
    frequent = marked.join(F.broadcast(slim), "_digest").where(stays)
    rest = marked.join(F.broadcast(slim.select("_digest")), "_digest", "left_anti").join(best, "_digest").where(stays)
    kept = frequent.dropDuplicates(["_digest"]).unionByName(rest.dropDuplicates(["_digest"]))
    return kept.select(*frame.columns)
