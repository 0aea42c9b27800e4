"""Department reports. Spend is allocated by baseline share, so ratios are indicative only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.config import LiftConfig
from promolift.functions.columns import aggregate, named, percent, ratio, rounded, whole
from promolift.functions.ranking import rank_league, rank_over
from promolift.operators.attribution import types_as_rows


def _dept_totals(store_dept: DataFrame) -> DataFrame:
    """Per department. Each store is one input row, so stores need no distinct count."""
    return aggregate(
        store_dept,
        ["dept"],
        {
            "stores": "count(store)",
            "baseline": "sum(sales_baseline)",
            "lift": "sum(lift_dollars)",
            "allocated": "sum(allocated_md_spend)",
        },
    ).selectExpr("*", f"{ratio('lift', 'allocated')} AS per_dollar")


_REPORTED = {
    "allocated_md_spend": whole("allocated"),
    "yoy_lift_dollars": whole("lift"),
    "yoy_growth_pct": rounded(percent("lift", "baseline"), 1),
    "sales_lift_per_allocated_dollar": rounded("per_dollar", 2),
}


def dept_league(store_dept: DataFrame, config: LiftConfig) -> DataFrame:
    """Departments ranked overall and within their materiality class."""
    low_base = f"stores < {config.min_stores} OR baseline < {config.min_baseline}"
    league = (
        _dept_totals(store_dept)
        .filter("allocated > 0")
        .selectExpr("*", f"if({low_base}, 'Low base - treat with caution', 'Material') AS materiality")
    )
    ranks = {"dept_rank": (), "rank_among_material": ("materiality",)}
    columns = {"dept": "dept", "stores": "stores", "baseline_sales": whole("baseline")} | _REPORTED
    return (
        rank_league(league, "per_dollar", ranks)
        .selectExpr(*named(columns), "materiality", *ranks)
        .orderBy("materiality", F.desc("sales_lift_per_allocated_dollar"), "dept")
    )


def dept_by_type_top(store_dept: DataFrame, config: LiftConfig) -> DataFrame:
    """Types within the departments that were allocated the most spend.

    A department is one row until its types become rows, so the top list is a
    plain top-k and needs no join back.
    """
    names = [f"{name}_{k}" for name in ("allocated", "attributed") for k in config.type_numbers]
    per_dept = aggregate(store_dept, ["dept"], {name: f"sum({name})" for name in names})
    all_types = " + ".join(f"allocated_{k}" for k in config.type_numbers)
    top = per_dept.orderBy(F.expr(all_types).desc(), "dept").limit(config.top_departments)
    rated = (
        types_as_rows(top, ["dept"], {"allocated": "allocated", "attributed": "attributed"}, config)
        .filter("allocated > 0")
        .selectExpr("*", f"{ratio('attributed', 'allocated')} AS per_dollar")
    )
    columns = {
        "dept": "dept",
        "markdown_type": "markdown_type",
        "allocated_spend": whole("allocated"),
        "attributed_lift": whole("attributed"),
        "sales_lift_per_allocated_dollar": rounded("per_dollar", 2),
        "best_type_in_dept": rank_over("per_dollar", ("dept",)),
    }
    return rated.selectExpr(*named(columns)).orderBy("dept", "best_type_in_dept", "markdown_type")


def dept_cut_list(store_dept: DataFrame, config: LiftConfig) -> DataFrame:
    """Departments with real spend that still went backwards, worst first."""
    return (
        _dept_totals(store_dept)
        .filter(f"lift < 0 AND allocated > {config.cut_min_spend}")
        .orderBy("lift", "dept")
        .selectExpr("dept", *named(_REPORTED))
    )
