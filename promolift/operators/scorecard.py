"""Which promotion type returns the most lift per dollar, overall and by store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.config import LiftConfig
from promolift.functions.columns import aggregate, named, percent, ratio, rounded, whole
from promolift.functions.ranking import rank_league, rank_over
from promolift.operators.attribution import combine_type_sums, type_sums, types_as_rows

BY_TYPE = {
    "spend": "spend",
    "active": "active",
    "lift": "lift",
    "net_lift": "net_lift",
}


def recommendation(lift: str, index: str, config: LiftConfig) -> str:
    """First rule that holds; an unknown index falls through to the last."""
    return (
        f"CASE WHEN {lift} <= 0 THEN 'Cut' WHEN {index} >= {config.double_down_at}D THEN 'Double down' "
        f"WHEN {index} >= {config.hold_at}D THEN 'Hold' ELSE 'Reduce' END"
    )


def score_types(by_type: DataFrame, config: LiftConfig, with_validity: bool = False) -> DataFrame:
    """Ratios, index, rank and recommendation from one row of sums per type.

    ``with_validity`` adds ``index_valid``: an index against a pooled ratio that
    is zero or negative orders the types backwards. The windows span one row per
    type.
    """
    rated = by_type.selectExpr(
        "*",
        f"{ratio('lift', 'spend')} AS per_dollar",
        f"{ratio('sum(lift) OVER ()', 'sum(spend) OVER ()')} AS pooled",
        f"{percent('spend', 'sum(spend) OVER ()')} AS spend_pct",
    )
    scored = rated.selectExpr("*", f"{ratio('per_dollar', 'pooled')} AS index")
    columns = {
        "markdown_type": "markdown_type",
        "total_spend": whole("spend"),
        "active_store_weeks": "active",
        "avg_spend_per_active_week": rounded(ratio("spend", "active"), 0),
        "pct_of_total_spend": rounded("spend_pct", 1),
        "attributed_lift": whole("lift"),
        "sales_lift_per_dollar": rounded("per_dollar", 2),
        "lift_per_active_week": rounded(ratio("lift", "active"), 0),
        "effectiveness_index": rounded("index", 2),
        "effectiveness_rank": rank_over("per_dollar"),
        "recommendation": recommendation("lift", "index", config),
        "net_lift_per_dollar_sensitivity": rounded(ratio("net_lift", "spend"), 2),
    }
    if with_validity:
        columns["index_valid"] = "coalesce(pooled, 0D) > 0"
    return scored.selectExpr(*named(columns)).orderBy(F.desc("sales_lift_per_dollar"), "markdown_type")


def scorecard_by_type(
    effect: DataFrame, config: LiftConfig, drift: Column | None = None, with_validity: bool = False
) -> DataFrame:
    """The headline scorecard. ``drift`` replaces the configured drift rate."""
    by_type = types_as_rows(type_sums(effect, [], config, drift), [], BY_TYPE, config)
    return score_types(by_type, config, with_validity)


def scorecard_by_type_holiday(effect: DataFrame, config: LiftConfig) -> DataFrame:
    """The same split by the holiday flag of the sales table."""
    split = effect.selectExpr("*", "if(sales_holiday = 1, 'Holiday week', 'Normal week') AS week_type")
    sums = type_sums(split, ["week_type"], config)
    columns = {
        "markdown_type": "markdown_type",
        "week_type": "week_type",
        "total_spend": whole("spend"),
        "active_store_weeks": "active",
        "attributed_lift": whole("lift"),
        "sales_lift_per_dollar": rounded(ratio("lift", "spend"), 2),
        "net_lift_per_dollar": rounded(ratio("net_lift", "spend"), 2),
    }
    by_type = types_as_rows(sums, ["week_type"], BY_TYPE, config)
    return by_type.selectExpr(*named(columns)).orderBy("markdown_type", "week_type")


def store_league(effect: DataFrame, stores: DataFrame, config: LiftConfig) -> DataFrame:
    """Stores ranked by lift per dollar. Spend is recorded per store, nothing is allocated."""
    totals = aggregate(
        effect,
        ["store"],
        {"lift": "sum(lift_dollars)", "baseline": "sum(sales_baseline)", "spend": "sum(total_md_spend)"},
    )
    described = totals.join(
        stores.selectExpr("Store AS store", "Type AS store_format", "Size AS store_size_sqft"), "store"
    ).selectExpr("*", f"{ratio('lift', 'spend')} AS per_dollar")
    columns = {
        "store": "store",
        "store_format": "store_format",
        "store_size_sqft": "store_size_sqft",
        "total_md_spend": whole("spend"),
        "yoy_lift_dollars": whole("lift"),
        "yoy_growth_pct": rounded(percent("lift", "baseline"), 1),
        "sales_lift_per_dollar": rounded("per_dollar", 2),
        "md_spend_pct_of_baseline": rounded(percent("spend", "baseline"), 2),
        "store_rank": "store_rank",
    }
    ranked = rank_league(described, "per_dollar", {"store_rank": ()})
    return ranked.selectExpr(*named(columns)).orderBy(F.desc("sales_lift_per_dollar"), "store")


def _with_format(sums: DataFrame, stores: DataFrame) -> DataFrame:
    return sums.join(stores.selectExpr("Store AS store", "Type AS store_format"), "store")


def type_by_format(store_sums: DataFrame, stores: DataFrame, config: LiftConfig) -> DataFrame:
    """Types within each store format, from the per-store sums."""
    by_format = combine_type_sums(_with_format(store_sums, stores), ["store_format"], config)
    rated = types_as_rows(by_format, ["store_format"], BY_TYPE, config).selectExpr(
        "*", f"{ratio('lift', 'spend')} AS per_dollar"
    )
    columns = {
        "markdown_type": "markdown_type",
        "store_format": "store_format",
        "total_spend": whole("spend"),
        "active_store_weeks": "active",
        "attributed_lift": whole("lift"),
        "sales_lift_per_dollar": rounded("per_dollar", 2),
        "rank_within_format": rank_over("per_dollar", ("store_format",)),
    }
    return rated.selectExpr(*named(columns)).orderBy("store_format", F.desc("sales_lift_per_dollar"), "markdown_type")


def type_by_store(store_sums: DataFrame, stores: DataFrame, config: LiftConfig) -> DataFrame:
    """Types within each store, where the store spent on them at all."""
    rated = (
        types_as_rows(_with_format(store_sums, stores), ["store", "store_format"], BY_TYPE, config)
        .filter("spend > 0")
        .selectExpr("*", f"{ratio('lift', 'spend')} AS per_dollar")
    )
    columns = {
        "store": "store",
        "store_format": "store_format",
        "markdown_type": "markdown_type",
        "total_spend": whole("spend"),
        "active_weeks": "active",
        "attributed_lift": whole("lift"),
        "sales_lift_per_dollar": rounded("per_dollar", 2),
        "best_type_rank_in_store": rank_over("per_dollar", ("store",)),
    }
    return rated.selectExpr(*named(columns)).orderBy("store", "best_type_rank_in_store", "markdown_type")
