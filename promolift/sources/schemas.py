"""Column types of the input tables and of the exported facts.

Money is DECIMAL: sums are then exact and do not depend on partitioning.
"""

from __future__ import annotations

from promolift.config import LiftConfig

MONEY = "DECIMAL(18,2)"

STORES = "Store INT, Type STRING, Size INT"


def sales_schema(dept_type: str = "INT") -> str:
    return f"Store INT, Dept {dept_type}, Date DATE, Weekly_Sales {MONEY}, IsHoliday BOOLEAN"


def features_schema(config: LiftConfig) -> str:
    spend = ", ".join(f"{name} {MONEY}" for name in config.spend_columns)
    return (
        f"Store INT, Date DATE, Temperature DOUBLE, Fuel_Price DOUBLE, {spend}, "
        "CPI DOUBLE, Unemployment DOUBLE, IsHoliday BOOLEAN"
    )


def export_schemas(dept_type: str = "INT") -> dict[str, str]:
    """Read-back schema per exported fact: ids whole numbers, money decimal.

    Attributed and allocated amounts are shares of money and stay DOUBLE.
    """
    dollars = "DECIMAL(38,2)"
    return {
        "fact_markdown_lift": (
            f"store INT, dept {dept_type}, type_no INT, markdown_type STRING, allocated_spend DOUBLE, "
            "attributed_lift DOUBLE, allocated_spend_holiday DOUBLE, attributed_lift_holiday DOUBLE"
        ),
        "fact_dept_sales": (
            f"store INT, dept {dept_type}, weeks BIGINT, window_sales {dollars}, baseline_sales {dollars}, "
            f"yoy_lift_dollars {dollars}, window_sales_holiday {dollars}, baseline_sales_holiday {dollars}"
        ),
        "fact_markdown_spend": (
            f"store INT, type_no INT, markdown_type STRING, total_spend {dollars}, active_weeks BIGINT, "
            f"total_spend_holiday {dollars}, active_weeks_holiday BIGINT, attributed_lift DOUBLE"
        ),
        "dim_store": "store INT, store_format STRING, store_size_sqft INT, size_band STRING",
    }
