"""RANK() for groups of known size and for leagues of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.functions.columns import ROWS

DIGITS = 9


def _over(within, order: str = "") -> str:
    parts = f"PARTITION BY {', '.join(within)} " if within else ""
    return f"OVER ({parts}{order})"


def rank_over(value: str, within: tuple[str, ...] = ()) -> str:
    """Descending RANK() by window. For groups bounded by the number of types."""
    return f"rank() {_over(within, f'ORDER BY {value} DESC')}"


def rank_league(league: DataFrame, value: str, ranks: dict[str, tuple[str, ...]], bins: int | None = None) -> DataFrame:
    """Descending RANK() over one row per store or department, without a task that sees all rows.

    ``ranks`` maps an output column to the columns it is ranked within. Nothing
    runs until the result is acted on, and every size takes the same path, in two
    levels. The values are cut at approximate quantiles. Slots follow the order
    of the values: every cut is a slot of its own and so is NULL, the others are
    the values between two cuts. The rows of each slot are counted, and a rank is
    one more than the rows of the slots before plus, between cuts, those with a
    higher value in the same slot. The result is exact however rough the
    quantiles are.

    Cuts and counts come from one scalar subquery, so they fit each other. The
    values are computed again there, and sums of DOUBLE may differ in their last
    digits from one run to the next; they are therefore ranked by ``DIGITS``
    decimals. A value that many rows share is a cut: its rows all have the same
    rank, need no ordering and are dealt out evenly. There are as many cuts as
    shuffle partitions, so that a slot is what a task is expected to hold.
    """
    bins = bins or max(2, int(league.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = sorted({key for within in ranks.values() for key in within})
    keyed = league.withColumn("_key", F.round(value, DIGITS))
    counted = _slotted(keyed, _quantiles(keyed, bins)).groupBy("_slot", *keys)
    counted = counted.agg(F.expr(f"{ROWS} AS _rows"), F.expr("any_value(_cuts) AS _cuts"))
    slots = f"collect_list(struct({', '.join(['_slot', *keys, '_rows'])}))"  # a few for each slot
    places = counted.agg(F.expr(f"struct(any_value(_cuts) AS cuts, {slots} AS slots)")).scalar()
    placed = keyed.withColumn("_places", places).withColumn("_cuts", F.col("_places.cuts"))
    # Rows of a cut or without a value are all first in their slot; they may lie anywhere.
    spread = f"-1 - pmod(xxhash64({', '.join(league.columns)}), {bins})"
    slotted = _slotted(placed, None).selectExpr(
        "*", "_slot % 2 = 1 AS _alone", f"if(_slot % 2 = 1, {spread}, _slot) AS _task"
    )
    for name, within in sorted(ranks.items(), key=lambda item: len(item[1])):
        ahead = " AND ".join(["slot._slot < _slot", *[f"slot.{key} <=> {key}" for key in within]])
        before = f"aggregate(filter(_places.slots, slot -> {ahead}), 0L, (sum, slot) -> sum + slot._rows)"
        inside = f"rank() {_over(['_task', *within], 'ORDER BY _key DESC')}"
        slotted = slotted.selectExpr("*", f"{before} + if(_alone, 1, {inside}) AS {name}")
    return slotted.select(*league.columns, *ranks)


def _quantiles(keyed: DataFrame, bins: int) -> Column:
    fractions = [step / bins for step in range(1, bins)]
    return keyed.select(F.percentile_approx("_key", fractions, 10 * bins)).scalar()


def _slotted(frame: DataFrame, cuts: Column | None) -> DataFrame:
    """The row's slot, from the highest values down: odd at a cut and for NULL, even between cuts."""
    with_cuts = frame if cuts is None else frame.withColumn("_cuts", F.array_distinct(F.coalesce(cuts, F.array())))
    above = "2 * size(filter(_cuts, cut -> cut > _key)) + if(array_contains(_cuts, _key), 1, 0)"
    return with_cuts.selectExpr("*", f"CAST(if(_key IS NULL, 2 * size(_cuts) + 1, {above}) AS BIGINT) AS _slot")
