"""Coverage and quality checks on the inputs, before any lift is trusted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from promolift.config import LiftConfig
from promolift.functions.columns import (
    ROWS,
    aggregate,
    as_double,
    count_where,
    flag,
    named,
    paid,
    per_type,
    percent,
    ratio,
    rounded,
    weeks_between,
    whole,
)


def _window(table: DataFrame, config: LiftConfig) -> DataFrame:
    return weeks_between(table, config.window_start, config.window_end)


def _baseline(table: DataFrame, config: LiftConfig) -> DataFrame:
    return weeks_between(table, config.baseline_start, config.baseline_end)


def _titled(check: str, columns: dict[str, str]) -> list[str]:
    return named({"check_name": f"'{check}'"} | columns)


def _each_spend(config: LiftConfig):
    return zip(config.type_numbers, config.spend_columns)


def window_shape(features: DataFrame, config: LiftConfig) -> DataFrame:
    shape = {
        "store_weeks": ROWS,
        "stores": "count(DISTINCT Store)",
        "weeks": "count(DISTINCT Date)",
        "first_week": "min(Date)",
        "last_week": "max(Date)",
    }
    return aggregate(_window(features, config), [], shape).selectExpr("'A1. window shape' AS check_name", "*")


def _null_rates(config: LiftConfig) -> dict[str, str]:
    return {
        f"md{k}_pct_null": rounded(percent(count_where(f"{column} IS NULL"), ROWS), 1)
        for k, column in _each_spend(config)
    }


def null_rate_by_month(features: DataFrame, config: LiftConfig) -> DataFrame:
    """Share of raw NULL spend per month, from the first month on record."""
    dated = weeks_between(features, None, config.window_end).selectExpr("*", "date_format(Date, 'yyyy-MM') AS month")
    rates = aggregate(dated, ["month"], {"store_weeks": ROWS} | _null_rates(config))
    return rates.selectExpr("'A2. coverage by month' AS check_name", "*").orderBy("month")


def null_rate_overall(features: DataFrame, config: LiftConfig) -> DataFrame:
    limited = weeks_between(features, None, config.window_end)
    return aggregate(limited, [], {"store_weeks": ROWS} | _null_rates(config))


def coactivity(features: DataFrame, config: LiftConfig) -> DataFrame:
    """How many types run at once. One row per count, so the total is a window of K+1 rows."""
    active = " + ".join(flag(f"{column} > 0") for column in config.spend_columns)
    counts = aggregate(
        _window(features, config).selectExpr(f"{active} AS types_active"),
        ["types_active"],
        {"store_weeks": ROWS},
    )
    return counts.selectExpr(
        *_titled(
            "B1. co-activity",
            {
                "types_active": "types_active",
                "store_weeks": "store_weeks",
                "pct_of_store_weeks": rounded(percent("store_weeks", "sum(store_weeks) OVER ()"), 1),
            },
        )
    ).orderBy("types_active")


def zero_spend_weeks(features: DataFrame, config: LiftConfig) -> DataFrame:
    spent = " + ".join(paid(column) for column in config.spend_columns)
    unpaid = _window(features, config).filter(f"{spent} = 0")
    return (
        aggregate(unpaid, ["Date"], {"stores_with_no_markdown": ROWS})
        .selectExpr("'B2. zero-markdown weeks' AS check_name", "Date", "stores_with_no_markdown")
        .orderBy("Date")
    )


def activity_by_type(features: DataFrame, config: LiftConfig) -> DataFrame:
    """Activity and spend per type. All types are summed in one pass and then become rows."""
    sums = {"store_weeks": ROWS}
    for k, column in _each_spend(config):
        sums |= {f"active_{k}": count_where(f"{paid(column)} > 0"), f"spend_{k}": f"sum({paid(column)})"}
    by_type = per_type(
        aggregate(_window(features, config), [], sums).filter("store_weeks > 0"),
        ["store_weeks"],
        {
            "active": [f"active_{k}" for k in config.type_numbers],
            "spend": [f"spend_{k}" for k in config.type_numbers],
        },
        config,
    )
    return by_type.selectExpr(
        *_titled(
            "B3. spend and activity by type",
            {
                "markdown_type": "markdown_type",
                "active_store_weeks": "active",
                "pct_store_weeks_active": rounded(percent("active", "store_weeks"), 1),
                "total_spend": whole("spend"),
                "avg_spend_per_active_week": rounded(ratio("spend", "active"), 0),
            },
        )
    ).orderBy("markdown_type")


def negative_spend(features: DataFrame, config: LiftConfig) -> DataFrame:
    counts = {f"md{k}_negative_weeks": count_where(f"{column} < 0") for k, column in _each_spend(config)}
    return aggregate(_window(features, config), [], counts).selectExpr(
        "'B4. negative markdown values' AS check_name", "*"
    )


def baseline_weeks(train: DataFrame, config: LiftConfig) -> DataFrame:
    """Weeks of the window with sales 364 days earlier. Both sides shrink to weeks first."""
    current = _window(train, config).selectExpr("Date AS week").distinct()
    partner = _baseline(train, config).selectExpr(f"date_add(Date, {config.offset_days}) AS week", "1 AS found").distinct()
    shifted = f"date_sub(week, {config.offset_days})"
    counts = {
        "window_weeks": "count(week)",
        "matched_baseline_weeks": "count(found)",
        "earliest_baseline_week": f"min({shifted})",
        "latest_baseline_week": f"max({shifted})",
    }
    return aggregate(current.join(partner, "week", "left"), [], counts).selectExpr(
        "'C1. baseline week match' AS check_name", "*"
    )


def holiday_alignment(train: DataFrame, config: LiftConfig) -> DataFrame:
    """Week pairs whose holiday flags differ. Both sides shrink to weeks first."""
    current = (
        _window(train, config)
        .selectExpr("Date AS window_week", "CAST(IsHoliday AS INT) AS window_is_holiday")
        .distinct()
    )
    partner = (
        _baseline(train, config)
        .selectExpr(
            f"date_add(Date, {config.offset_days}) AS window_week", "CAST(IsHoliday AS INT) AS baseline_is_holiday"
        )
        .distinct()
    )
    return (
        current.join(partner, "window_week")
        .filter("window_is_holiday <> baseline_is_holiday")
        .selectExpr(
            *_titled(
                "C2. holiday misalignment",
                {
                    "window_week": "window_week",
                    "window_is_holiday": "window_is_holiday",
                    "baseline_week": f"date_sub(window_week, {config.offset_days})",
                    "baseline_is_holiday": "baseline_is_holiday",
                },
            )
        )
    )


def pair_coverage(train: DataFrame, config: LiftConfig) -> DataFrame:
    """How many store-department weeks of the window have a baseline."""
    keys = ["Store", "Dept", "Date"]
    current = _window(train, config).select(*keys)
    partner = _baseline(train, config).selectExpr(
        "Store", "Dept", f"date_add(Date, {config.offset_days}) AS Date", "Weekly_Sales"
    )
    counted = aggregate(
        current.join(partner, keys, "left"),
        [],
        {"window_rows": ROWS, "matched_rows": count_where("Weekly_Sales IS NOT NULL")},
    )
    return counted.selectExpr(
        *_titled(
            "C3. store-dept-week coverage",
            {
                "window_rows": "window_rows",
                "matched_rows": "matched_rows",
                "unmatched_rows": "window_rows - matched_rows",
                "pct_matched": rounded(percent("matched_rows", "window_rows"), 1),
            },
        )
    )


_SALES = {"sales_window": "sum(sales_window)", "sales_baseline": "sum(sales_baseline)"}


def _growth(sums: DataFrame, check: str, name: str) -> DataFrame:
    return sums.selectExpr(
        *_titled(
            check,
            {
                "store_dept_weeks": "store_dept_weeks",
                "window_sales": whole("sales_window"),
                "baseline_sales": whole("sales_baseline"),
                name: rounded(f"{ratio('sales_window', 'sales_baseline')} - 1", 4),
            },
        )
    )


def drift_zero_spend(effect: DataFrame) -> DataFrame:
    """Year-on-year growth where no promotion ran: the drift estimate."""
    unpaid = effect.filter("total_md_spend = 0")
    sums = aggregate(unpaid, [], {"store_dept_weeks": "coalesce(sum(depts), 0)"} | _SALES)
    return _growth(sums, "C4. YoY drift on zero-markdown weeks", "yoy_drift_rate")


def growth_full(pair: DataFrame) -> DataFrame:
    sums = aggregate(pair, [], {"store_dept_weeks": ROWS} | _SALES)
    return _growth(sums, "C5. YoY growth, full window", "yoy_growth_rate")


def baseline_spend(features: DataFrame, config: LiftConfig) -> DataFrame:
    """Spend in the weeks the window is compared with, which the comparison takes to have none."""
    spend = " + ".join(paid(column) for column in config.spend_columns)
    weeks = weeks_between(features, config.baseline_start, config.baseline_end).selectExpr(f"{spend} AS spend")
    sums = {"store_weeks": ROWS, "with_spend": f"coalesce({count_where('spend > 0')}, 0)", "spend": "sum(spend)"}
    return aggregate(weeks, [], sums).selectExpr("store_weeks", "with_spend", f"{rounded('coalesce(spend, 0)', 2)} AS spend")


def join_integrity(train: DataFrame, features: DataFrame) -> DataFrame:
    """Sales rows without a spend row, and sales rows whose holiday flags disagree.

    Sales are counted per store-week before the join.
    """
    sales = aggregate(
        train.selectExpr("Store", "Date", "CAST(IsHoliday AS INT) AS sales_holiday"),
        ["Store", "Date", "sales_holiday"],
        {"n": ROWS},
    )
    flags = features.selectExpr("Store", "Date", "CAST(IsHoliday AS INT) AS spend_holiday", "1 AS found")
    return aggregate(
        sales.join(flags, ["Store", "Date"], "left"),
        [],
        {
            "sales_rows": "sum(n)",
            "unmatched_rows": "sum(if(found IS NULL, n, 0))",
            "holiday_mismatches": "sum(if(sales_holiday <> spend_holiday, n, 0))",
        },
    )


def holiday_consistency(train: DataFrame, config: LiftConfig) -> DataFrame:
    """Store-weeks of the window whose departments disagree on the holiday flag.

    Each such store-week counts its spend twice in every join at that grain.
    """
    is_holiday = "CAST(IsHoliday AS INT)"
    flags = aggregate(
        _window(train, config),
        ["Store", "Date"],
        {"lowest": f"min({is_holiday})", "highest": f"max({is_holiday})"},
    )
    return aggregate(
        flags, [], {"store_weeks": ROWS, "disagreeing_store_weeks": count_where("lowest <> highest")}
    )


KEYS = {"train": ["Store", "Dept", "Date"], "features": ["Store", "Date"], "stores": ["Store"]}


def key_uniqueness(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and repeated keys per input table; repeats would multiply pairs."""
    counted = [
        aggregate(
            aggregate(tables[name], keys, {"n": ROWS}),
            [],
            {"rows": "coalesce(sum(n), 0)", "repeated_keys": f"coalesce({count_where('n > 1')}, 0)"},
        ).selectExpr(f"'{name}' AS table_name", "*")
        for name, keys in KEYS.items()
    ]
    return reduce(DataFrame.unionAll, counted)


def profile_tables(train: DataFrame, features: DataFrame, stores: DataFrame) -> DataFrame:
    """Rows, date range and distinct keys per table.

    Sales shrink to store x department before the distinct counts, so the fact
    is neither expanded nor shuffled row by row.
    """
    dated = {"n": ROWS, "first": "min(Date)", "last": "max(Date)"}
    shape = {"rows": "sum(n)", "stores": "count(DISTINCT Store)"}
    weeks = {"first_week": "min(first)", "last_week": "max(last)"}
    sales = aggregate(
        aggregate(train, ["Store", "Dept"], dated), [], shape | {"depts": "count(DISTINCT Dept)"} | weeks
    )
    spend = aggregate(
        aggregate(features, ["Store"], dated), [], shape | {"depts": "CAST(NULL AS BIGINT)"} | weeks
    )
    shops = aggregate(
        aggregate(stores, ["Store"], {"n": ROWS}),
        [],
        shape
        | {
            "depts": "CAST(NULL AS BIGINT)",
            "first_week": "CAST(NULL AS DATE)",
            "last_week": "CAST(NULL AS DATE)",
        },
    )
    profiles = {"train": sales, "features": spend, "stores": shops}
    return reduce(
        DataFrame.unionAll,
        [frame.selectExpr(f"'{name}' AS table_name", "*") for name, frame in profiles.items()],
    )


def profile_formats(stores: DataFrame) -> DataFrame:
    return aggregate(stores.selectExpr("Type AS store_format"), ["store_format"], {"stores": ROWS}).orderBy(
        "store_format"
    )


def drift_charge(pair: DataFrame, config: LiftConfig) -> DataFrame:
    """The drift assumption in money, beside the lift it would be charged against."""
    rate = repr(float(config.drift_rate)) + "D"
    sums = aggregate(pair, [], {"baseline": "sum(sales_baseline)", "lift": "sum(lift_dollars)"})
    return sums.selectExpr(
        *named(
            {
                "drift_rate": rate,
                "baseline_sales": whole("baseline"),
                "measured_lift": whole("lift"),
                "drift_charge": rounded(f"{as_double('baseline')} * {rate}", 0),
            }
        )
    )
