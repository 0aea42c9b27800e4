"""Do the grains add up? Each job returns the totals and the gaps between them.

The totals agree only if every store-week has a pair and a department with a
positive baseline, so gaps are reported and never asserted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from promolift.config import LiftConfig
from promolift.functions.columns import aggregate, as_double, named, paid, ratio, rounded, weeks_between
from promolift.functions.ranking import rank_over
from promolift.operators.base import STORE_WEEK


def _side_by_side(totals: dict[str, tuple[DataFrame, str]], gaps: dict[str, tuple[str, str]]) -> DataFrame:
    """Several one-row totals as the columns of one row, with differences of two of them."""
    stacked = reduce(
        DataFrame.unionAll,
        [
            aggregate(frame, [], {"amount": as_double(f"sum({column})")}).selectExpr(f"'{name}' AS grain", "amount")
            for name, (frame, column) in totals.items()
        ],
    )
    row = aggregate(stacked, [], {name: f"max(CASE WHEN grain = '{name}' THEN amount END)" for name in totals})
    return row.selectExpr(
        *named({name: rounded(name, 2) for name in totals}),
        *named({gap: rounded(f"{left} - {right}", 2) for gap, (left, right) in gaps.items()}),
    )


def reconcile_spend(features: DataFrame, spend_long: DataFrame, fact_spend: DataFrame, config: LiftConfig) -> DataFrame:
    raw = weeks_between(features, config.window_start, config.window_end)
    return _side_by_side(
        {
            "raw_spend": (raw, " + ".join(paid(column) for column in config.spend_columns)),
            "long_spend": (spend_long, "spend"),
            "store_type_spend": (fact_spend, "total_spend"),
        },
        {"long_gap": ("long_spend", "raw_spend"), "store_type_gap": ("store_type_spend", "raw_spend")},
    )


def reconcile_lift(fact_spend: DataFrame, store_dept: DataFrame, fact_lift: DataFrame, config: LiftConfig) -> DataFrame:
    """Lift by type against lift by department and type, before and after the
    export leaves out rows without allocated spend."""
    attributed = " + ".join(f"coalesce(attributed_{k}, 0D)" for k in config.type_numbers)
    return _side_by_side(
        {
            "type_lift": (fact_spend, "attributed_lift"),
            "dept_type_lift": (store_dept, attributed),
            "exported_lift": (fact_lift, "attributed_lift"),
        },
        {"gap": ("dept_type_lift", "type_lift"), "export_gap": ("exported_lift", "type_lift")},
    )


def reconcile_alloc(fact_spend: DataFrame, fact_lift: DataFrame) -> DataFrame:
    return _side_by_side(
        {"store_spend": (fact_spend, "total_spend"), "allocated_spend": (fact_lift, "allocated_spend")},
        {"gap": ("allocated_spend", "store_spend")},
    )


def reconcile_decomposition(spend: DataFrame, lift: DataFrame) -> DataFrame:
    """Lift in weeks with spend, in weeks without, and in weeks the spend table lacks."""
    joined = lift.join(spend.select(*STORE_WEEK, "total_md_spend"), STORE_WEEK, "left")

    def part(condition: str) -> str:
        return f"coalesce(sum(if({condition}, lift_dollars, 0)), 0)"

    parts = {
        "attributed_lift": part("total_md_spend > 0"),
        "zero_spend_lift": part("total_md_spend = 0"),
        "no_spend_row_lift": part("total_md_spend IS NULL"),
        "total_yoy_lift": part("true"),
    }
    return aggregate(joined, [], parts).selectExpr(
        *named({name: rounded(name, 2) for name in parts}),
        f"{rounded('total_yoy_lift - attributed_lift - zero_spend_lift - no_spend_row_lift', 2)} AS gap",
    )


def method_comparison(by_type: DataFrame) -> DataFrame:
    """Attribution and both intensity contrasts side by side, from one row of sums per type."""
    rated = by_type.selectExpr(
        "*",
        f"{ratio('lift', 'spend')} AS attributed",
        f"{ratio('all_more_sales', 'all_more_spend')} AS marginal",
        f"{ratio('normal_more_sales', 'normal_more_spend')} AS marginal_normal",
    )
    columns = {
        "markdown_type": "markdown_type",
        "sales_lift_per_dollar": rounded("attributed", 2),
        "effectiveness_rank": rank_over("attributed"),
        "marginal_lift_per_dollar": rounded("marginal", 2),
        "marginal_rank": f"if(all_stores > 0, {rank_over('marginal')}, NULL)",
        "stores_positive": "if(all_stores > 0, all_stores_positive, NULL)",
        "marginal_lift_per_dollar_ex_holiday": rounded("marginal_normal", 2),
        "marginal_rank_ex_holiday": f"if(normal_stores > 0, {rank_over('marginal_normal')}, NULL)",
    }
    return rated.selectExpr(*named(columns)).orderBy("markdown_type")
