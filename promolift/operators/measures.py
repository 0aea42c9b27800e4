"""Report measures over the additive facts, for any dimensions and filters.

Every ratio divides sums, so it is right at each level it is asked for. Filters
map a column to the values kept; columns of the store dimension may be used
like those of the fact.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.functions.columns import aggregate, percent, ratio, rounded

Filters = Mapping[str, Iterable]

TYPE = "markdown_type"


def with_store(fact: DataFrame, dim_store: DataFrame) -> DataFrame:
    """Fact rows with their store's attributes; a store missing there keeps its rows."""
    return fact.join(dim_store, "store", "left")


def _kept(fact: DataFrame, filters: Filters | None) -> DataFrame:
    for column, values in (filters or {}).items():
        fact = fact.filter(F.col(column).isin(*values))
    return fact


def _sums(fact: DataFrame, dims: list[str], sums: dict[str, str], filters: Filters | None) -> DataFrame:
    return aggregate(_kept(fact, filters), dims, {name: f"sum({column})" for name, column in sums.items()})


def type_measures(fact_spend: DataFrame, dims: list[str], filters: Filters | None = None) -> DataFrame:
    """Total spend, attributed lift and lift per dollar."""
    sums = {"total_spend": "total_spend", "attributed_lift": "attributed_lift"}
    return _sums(fact_spend, dims, sums, filters).selectExpr(
        "*", f"{ratio('attributed_lift', 'total_spend')} AS sales_lift_per_dollar"
    )


def index_measure(fact_spend: DataFrame, dims: list[str], filters: Filters | None = None) -> DataFrame:
    """Lift per dollar over the same figure with any choice of type lifted.

    The other dimensions and filters stay in force on both sides. One aggregation
    down to dims x type serves both; the window spans the types of one context.
    """
    filters = dict(filters or {})
    types = filters.pop(TYPE, None)
    others = [dim for dim in dims if dim != TYPE]
    by_type = _sums(fact_spend, [*others, TYPE], {"spend": "total_spend", "lift": "attributed_lift"}, filters)
    context = f"OVER ({'PARTITION BY ' + ', '.join(others) if others else ''})"
    pooled = by_type.selectExpr("*", f"{ratio(f'sum(lift) {context}', f'sum(spend) {context}')} AS pooled")
    chosen = _kept(pooled, None if types is None else {TYPE: types})
    return aggregate(
        chosen, dims, {"spend": "sum(spend)", "lift": "sum(lift)", "pooled": "max(pooled)"}
    ).selectExpr(*dims, f"{ratio(ratio('lift', 'spend'), 'pooled')} AS effectiveness_index")


def dept_measures(fact_lift: DataFrame, dims: list[str], filters: Filters | None = None) -> DataFrame:
    """Allocated spend, attributed lift and their ratio for departments."""
    sums = {"dept_allocated_spend": "allocated_spend", "dept_attributed_lift": "attributed_lift"}
    return _sums(fact_lift, dims, sums, filters).selectExpr(
        "*", f"{ratio('dept_attributed_lift', 'dept_allocated_spend')} AS dept_sales_lift_per_dollar"
    )


def yoy_measures(fact_sales: DataFrame, dims: list[str], filters: Filters | None = None) -> DataFrame:
    """Actual year-on-year lift, and growth as a fraction of the baseline."""
    sums = {"actual_yoy_lift": "yoy_lift_dollars", "baseline": "baseline_sales"}
    return _sums(fact_sales, dims, sums, filters).selectExpr(
        *dims, "actual_yoy_lift", f"{ratio('actual_yoy_lift', 'baseline')} AS yoy_growth"
    )


def format_type_matrix(fact_spend: DataFrame, dim_store: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Lift per dollar by store format, size band and type."""
    return type_measures(with_store(fact_spend, dim_store), ["store_format", "size_band", TYPE], filters)


def holiday_share(fact_spend: DataFrame, dims: list[str], filters: Filters | None = None) -> DataFrame:
    """Spend, its part in holiday weeks, and that part in percent."""
    sums = {"spend": "total_spend", "holiday_spend": "total_spend_holiday"}
    return _sums(fact_spend, dims, sums, filters).selectExpr(
        *dims, "spend", "holiday_spend", f"{rounded(percent('holiday_spend', 'spend'), 1)} AS holiday_share_pct"
    )


def holiday_split(fact_lift: DataFrame, dims: list[str], filters: Filters | None = None) -> DataFrame:
    """Lift per dollar in holiday and in normal weeks.

    Taken from the fact that carries the holiday part of both spend and lift.
    """
    sums = {
        "spend": "allocated_spend",
        "lift": "attributed_lift",
        "holiday_spend": "allocated_spend_holiday",
        "holiday_lift": "attributed_lift_holiday",
    }
    return _sums(fact_lift, dims, sums, filters).selectExpr(
        *dims,
        f"{ratio('holiday_lift', 'holiday_spend')} AS holiday_lift_per_dollar",
        f"{ratio('(lift - holiday_lift)', '(spend - holiday_spend)')} AS normal_lift_per_dollar",
    )
