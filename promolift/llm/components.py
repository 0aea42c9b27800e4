"""Connected components by alternating large-star and small-star joins over a written edge table.

Native DataFrame work only. Every round replaces edges by edges to smaller neighbours (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014); a star is reached after a number of rounds logarithmic in practice. Each
round is written to the shared folder, so its lineage stays short and no link passes through the driver. A node with
very many neighbours is handled by partial minima and by the skew join, never by collecting its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import drop_paths, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    lower = down.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return lower.union(least.select("a", F.col("low").alias("b")))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b")).alias("y"))
    return tuple(row.first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of any one orderable type to (node, component): the least node each node reaches.

    Only nodes that occur in a link between two different nodes are returned. Repeated and reversed links, loops and
    links with a null end have no effect; no links give an empty table.
    """
    current, path = written(_clean(links.select("a", "b").where("a is not null and b is not null")), "links")
    state = _state(current)
    while state[0]:
        after, new_path = written(_clean(_small_star(_clean(_large_star(current)))), "links")
        before, state = state, _state(after)
        drop_paths(links.sparkSession, [path])
        current, path = after, new_path
        if state == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
