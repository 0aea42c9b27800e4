"""Additive fact tables for reporting: sums only, so ratios hold under any filter."""

from __future__ import annotations

from pyspark.sql import DataFrame

from promolift.config import LiftConfig
from promolift.functions.columns import ROWS, aggregate
from promolift.operators.attribution import types_as_rows


def fact_type_lift(store_dept: DataFrame, config: LiftConfig) -> DataFrame:
    """store x department x type: allocated spend and attributed lift, and their holiday part."""
    sums = {
        "allocated_spend": "allocated",
        "attributed_lift": "attributed",
        "allocated_spend_holiday": "allocated_holiday",
        "attributed_lift_holiday": "attributed_holiday",
    }
    return types_as_rows(store_dept, ["store", "dept"], sums, config).filter("allocated_spend > 0")


def fact_dept_sales(pair: DataFrame) -> DataFrame:
    """store x department: sales, baseline and lift, and their holiday part."""
    return aggregate(
        pair,
        ["store", "dept"],
        {
            "weeks": ROWS,
            "window_sales": "sum(sales_window)",
            "baseline_sales": "sum(sales_baseline)",
            "yoy_lift_dollars": "sum(lift_dollars)",
            "window_sales_holiday": "sum(if(is_holiday = 1, sales_window, 0))",
            "baseline_sales_holiday": "sum(if(is_holiday = 1, sales_baseline, 0))",
        },
    )


def fact_type_spend(store_sums: DataFrame, config: LiftConfig) -> DataFrame:
    """store x type: recorded spend, active weeks, their holiday part, attributed lift."""
    sums = {
        "total_spend": "spend",
        "active_weeks": "active",
        "total_spend_holiday": "spend_holiday",
        "active_weeks_holiday": "active_holiday",
        "attributed_lift": "lift",
    }
    return types_as_rows(store_sums, ["store"], sums, config)


def dim_store(stores: DataFrame, config: LiftConfig) -> DataFrame:
    """One row per store with its format, size and size band."""
    bands = " ".join(
        f"WHEN Size >= {at_least} THEN '{name}'" for at_least, name in sorted(config.size_bands, reverse=True)
    )
    return stores.selectExpr(
        "Store AS store",
        "Type AS store_format",
        "Size AS store_size_sqft",
        f"CASE {bands} ELSE '{config.smallest_band}' END AS size_band",
    )
