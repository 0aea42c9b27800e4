"""Lift attributed to types, and spend allocated to departments, at any grain.

Sums are built with one column per type and turned into one row per type only
after the aggregation, so the rows that are joined and shuffled do not multiply
with the number of types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from promolift.config import LiftConfig
from promolift.functions.columns import ROWS, aggregate, as_double, flag, per_type
from promolift.operators.base import (
    STORE_WEEK,
    positive_baseline,
    share_name,
    spend_name,
    with_dept_share,
    with_shares,
)

STORE_TYPE_SUMS = ("spend", "active", "spend_holiday", "active_holiday", "lift", "net_lift")


def type_sums(effect: DataFrame, keys: list[str], config: LiftConfig, drift: Column | None = None) -> DataFrame:
    """Per key, the additive sums of every type, named ``<sum>_<type>``.

    The net lift charges the baseline a year's drift: the configured rate, or
    ``drift``, a value known only when the query runs.
    """
    rate = repr(float(config.drift_rate)) + "D"
    if drift is not None:
        effect, rate = effect.withColumn("drift_rate", drift), "drift_rate"
    lift = as_double("lift_dollars")
    net_lift = f"({as_double('sales_window')} - {as_double('sales_baseline')} * (1D + {rate}))"
    sums = {"store_weeks": ROWS}
    for k in config.type_numbers:
        spend, active, share = spend_name(k), flag(f"{spend_name(k)} > 0"), share_name(k)
        sums |= {
            f"spend_{k}": f"sum({spend})",
            f"active_{k}": f"sum({active})",
            f"spend_holiday_{k}": f"sum(if(is_holiday = 1, {spend}, 0))",
            f"active_holiday_{k}": f"sum(if(is_holiday = 1, {active}, 0))",
            f"lift_{k}": f"sum({lift} * {share})",
            f"net_lift_{k}": f"sum({net_lift} * {share})",
        }
    # Without keys an empty input still yields a row; it has no types to report.
    return aggregate(effect, keys, sums).filter("store_weeks > 0")


def combine_type_sums(sums: DataFrame, keys: list[str], config: LiftConfig) -> DataFrame:
    """Roll ``type_sums`` up to coarser keys."""
    names = [f"{name}_{k}" for name in STORE_TYPE_SUMS for k in config.type_numbers]
    return aggregate(sums, keys, {name: f"sum({name})" for name in names})


def types_as_rows(sums: DataFrame, keep: list[str], names: dict[str, str], config: LiftConfig) -> DataFrame:
    """One row per type; ``names`` maps an output column to a sum's prefix."""
    values = {out: [f"{name}_{k}" for k in config.type_numbers] for out, name in names.items()}
    return per_type(sums, keep, values, config)


def store_dept_sums(pair: DataFrame, spend: DataFrame, config: LiftConfig) -> DataFrame:
    """Additive sums per store and department, from which every department report derives.

    Spend and the positive baseline meet at the store-week first, so the pairs
    take part in a single join.
    """
    store_weeks = with_shares(spend.drop("is_holiday"), config).join(positive_baseline(pair), STORE_WEEK)
    sums = {
        "sales_baseline": "sum(sales_baseline)",
        "lift_dollars": "sum(lift_dollars)",
        "allocated_md_spend": f"sum({as_double('total_md_spend')} * dept_baseline_share)",
    }
    for k in config.type_numbers:
        allocated = f"{as_double(spend_name(k))} * dept_baseline_share"
        attributed = f"{as_double('lift_dollars')} * {share_name(k)}"
        sums |= {
            f"allocated_{k}": f"sum({allocated})",
            f"attributed_{k}": f"sum({attributed})",
            f"allocated_holiday_{k}": f"sum(if(is_holiday = 1, {allocated}, 0D))",
            f"attributed_holiday_{k}": f"sum(if(is_holiday = 1, {attributed}, 0D))",
        }
    return aggregate(with_dept_share(pair, store_weeks), ["store", "dept"], sums)
