"""The five base frames every report starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from promolift.config import LiftConfig
from promolift.functions.columns import (
    ROWS,
    aggregate,
    as_double,
    flag,
    named,
    paid,
    per_type,
    ratio,
    weeks_between,
)

STORE_WEEK = ["store", "week"]


def spend_name(number: int) -> str:
    return f"md{number}"


def share_name(number: int) -> str:
    return f"share{number}"


def spend_store_week(features: DataFrame, config: LiftConfig) -> DataFrame:
    """Cleaned spend per store and week of the window, one column per type."""
    names = [spend_name(k) for k in config.type_numbers]
    spends = {name: paid(column) for name, column in zip(names, config.spend_columns)}
    cleaned = weeks_between(features, config.window_start, config.window_end).selectExpr(
        "Store AS store", "Date AS week", "CAST(IsHoliday AS INT) AS is_holiday", *named(spends)
    )
    return cleaned.selectExpr(
        "*",
        f"{' + '.join(names)} AS total_md_spend",
        f"{' + '.join(flag(f'{name} > 0') for name in names)} AS types_active",
    )


def with_shares(spend: DataFrame, config: LiftConfig) -> DataFrame:
    """Each type's part of the store-week's spend; NULL in a week without spend.

    Computed here, once per store-week, rather than on the rows joined to it.
    """
    spent = spend.selectExpr("*", "nullif(CAST(total_md_spend AS DOUBLE), 0D) AS spent")
    shares = {share_name(k): f"{as_double(spend_name(k))} / spent" for k in config.type_numbers}
    return spent.selectExpr("*", *named(shares)).drop("spent")


def spend_long(spend: DataFrame, config: LiftConfig) -> DataFrame:
    """One row per store, week and type, with the share lift is attributed by."""
    return per_type(
        with_shares(spend, config),
        ["store", "week", "is_holiday"],
        {
            "spend": [spend_name(k) for k in config.type_numbers],
            "is_active": [flag(f"{spend_name(k)} > 0") for k in config.type_numbers],
            "spend_share": [share_name(k) for k in config.type_numbers],
        },
        config,
    )


def yoy_pair(train: DataFrame, config: LiftConfig) -> DataFrame:
    """Each store-department week of the window beside the one 364 days earlier.

    The baseline side carries its own literal date range: no range follows from
    the shifted join key, and without it all years would be read and shuffled.
    """
    window = weeks_between(train, config.window_start, config.window_end).selectExpr(
        "Store AS store",
        "Dept AS dept",
        "Date AS week",
        "CAST(IsHoliday AS INT) AS is_holiday",
        "Weekly_Sales AS sales_window",
    )
    baseline = weeks_between(train, config.baseline_start, config.baseline_end).selectExpr(
        "Store AS store",
        "Dept AS dept",
        f"date_add(Date, {config.offset_days}) AS week",
        "Weekly_Sales AS sales_baseline",
    )
    return window.join(baseline, ["store", "dept", "week"]).selectExpr(
        "*", "sales_window - sales_baseline AS lift_dollars"
    )


def clustered(pair: DataFrame) -> DataFrame:
    """Pairs laid out for storing: all weeks of a store and department together.

    Reports sum over those weeks, so a scan of the stored copy combines most rows
    before any shuffle.
    """
    return pair.hint("rebalance", "store", "dept")


def lift_store_week(pair: DataFrame) -> DataFrame:
    """Pairs summed to the store-week, the grain at which spend is recorded."""
    return aggregate(
        pair,
        ["store", "week", "is_holiday"],
        {
            "depts": ROWS,
            "sales_window": "sum(sales_window)",
            "sales_baseline": "sum(sales_baseline)",
            "lift_dollars": "sum(lift_dollars)",
        },
    )


def positive_baseline(pair: DataFrame) -> DataFrame:
    """Baseline sales of the departments above zero, per store-week."""
    return aggregate(
        pair, STORE_WEEK, {"positive_baseline": "sum(if(sales_baseline > 0, sales_baseline, 0))"}
    )


def with_dept_share(pair: DataFrame, store_weeks: DataFrame) -> DataFrame:
    """Pairs joined to a frame with one ``positive_baseline`` per store-week.

    A join to sums that combine before their shuffle, not a window that would
    gather each store-week in one task. The rebalance step gives the sums a
    shuffle of their own: only between two plain shuffles does the skew join
    split a store-week that holds much of the data.
    """
    share = ratio("sales_baseline", "positive_baseline")
    return pair.join(store_weeks.hint("rebalance"), STORE_WEEK).selectExpr(
        "*",
        f"if(sales_baseline > 0 AND positive_baseline > 0, {share}, 0D) AS dept_baseline_share",
    )


def lift_dept_week(pair: DataFrame) -> DataFrame:
    """Pairs with the department's share of the store-week's positive baseline."""
    return with_dept_share(pair, positive_baseline(pair)).select(*pair.columns, "dept_baseline_share")


def store_week_effect(spend: DataFrame, lift: DataFrame, config: LiftConfig) -> DataFrame:
    """Spend, its shares and lift side by side per store-week.

    ``is_holiday`` is the flag of the spend table, ``sales_holiday`` that of the
    sales table. Types stay columns, so nothing fans out before it is summed.
    """
    return with_shares(spend, config).join(lift.withColumnRenamed("is_holiday", "sales_holiday"), STORE_WEEK)
