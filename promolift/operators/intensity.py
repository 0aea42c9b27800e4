"""Cross-check without attribution: heavy against light weeks of the same store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.config import LiftConfig
from promolift.functions.columns import (
    ROWS,
    aggregate,
    as_double,
    count_where,
    flag,
    named,
    per_type,
    percent,
    ratio,
    rounded,
)
from promolift.functions.ranking import rank_over
from promolift.operators.base import share_name, spend_name


def _tiled(frame: DataFrame, ties: str, config: LiftConfig) -> DataFrame:
    """Weeks of each store cut into tiles by each type's spend, ``tile1`` and so on.

    All windows share one shuffle by store, and types stay columns. The group is
    the window's weeks of one store, so it does not grow with the data. Equal
    spends are ordered by week, which makes the cut repeatable.
    """
    tiles = {
        f"tile{k}": f"ntile({config.tiles}) OVER (PARTITION BY store ORDER BY {spend_name(k)}, {ties})"
        for k in config.type_numbers
    }
    return frame.selectExpr("*", *named(tiles))


_SIDES = {"spend": "", "sales": "sales_window", "base": "sales_baseline"}


def _side_sums(config: LiftConfig, tile: str = "tile", family: str = "") -> dict[str, str]:
    """Per type, what the top and the bottom tile hold. A missing tile leaves its sums NULL."""
    return {
        f"{family}{side}_{name}_{k}": f"sum(CASE WHEN {tile}{k} = {number} THEN {column or spend_name(k)} END)"
        for side, number in (("top", config.tiles), ("low", 1))
        for name, column in _SIDES.items()
        for k in config.type_numbers
    }


def _side_values(config: LiftConfig, family: str = "") -> dict[str, list[str]]:
    names = [f"{family}{side}_{name}" for side in ("top", "low") for name in _SIDES]
    return {name: [f"{name}_{k}" for k in config.type_numbers] for name in names}


def _measured(family: str = "") -> str:
    """Both tiles are there and have a baseline, as in an inner join of the two."""
    return f"{family}low_base > 0 AND {family}top_base > 0"


def _differences(family: str = "") -> dict[str, str]:
    """What the top tile spent and sold more than the store's own trend, and both growths."""
    own_trend = ratio(f"{family}low_sales", f"{family}low_base")
    return {
        "more_spend": f"{family}top_spend - {family}low_spend",
        "more_sales": f"{as_double(f'{family}top_sales')} - {as_double(f'{family}top_base')} * {own_trend}",
        "top_growth": f"{ratio(f'{family}top_sales', f'{family}top_base')} - 1",
        "bottom_growth": f"{own_trend} - 1",
    }


def _contrast(effect: DataFrame, config: LiftConfig) -> DataFrame:
    """Top against bottom tile per store and type, in one conditional aggregation.

    Types become rows only after the sums.
    """
    by_store = aggregate(_tiled(effect, "week, sales_holiday", config), ["store"], _side_sums(config))
    sides = per_type(by_store, ["store"], _side_values(config), config).filter(_measured())
    return sides.selectExpr("store", "type_no", "markdown_type", *named(_differences()))


def both_contrasts(effect: DataFrame, config: LiftConfig) -> DataFrame:
    """Per type, the sums behind attribution and behind the contrasts over all weeks and over normal weeks.

    ``all_`` and ``normal_`` are two families of tiles over one shuffle by store:
    windows by store and holiday flag need no other one, and of their tiles only
    those of normal weeks are summed. A family's sums are NULL for a type that
    no store measures.
    """
    families = {"all_": ("store", "true"), "normal_": ("store, is_holiday", "is_holiday = 0")}
    tiles, sums, values, by_type = {}, {}, {}, {"spend": "sum(spend)", "lift": "sum(lift)"}
    for family, (within, weeks) in families.items():
        for k in config.type_numbers:
            cut = f"ntile({config.tiles}) OVER (PARTITION BY {within} ORDER BY {spend_name(k)}, week, sales_holiday)"
            tiles[f"{family}tile{k}"] = f"if({weeks}, {cut}, NULL)"
        sums |= _side_sums(config, f"{family}tile", family)
        values |= _side_values(config, family)
        more = {name: f"if({_measured(family)}, {value}, NULL)" for name, value in _differences(family).items()}
        by_type |= {
            f"{family}stores": count_where(_measured(family)),
            f"{family}more_spend": f"sum({more['more_spend']})",
            f"{family}more_sales": f"sum({more['more_sales']})",
            f"{family}stores_positive": count_where(f"{more['top_growth']} > {more['bottom_growth']}"),
        }
    for k in config.type_numbers:
        sums |= {
            f"spend_{k}": f"sum({spend_name(k)})",
            f"lift_{k}": f"sum({as_double('lift_dollars')} * {share_name(k)})",
        }
    values |= {name: [f"{name}_{k}" for k in config.type_numbers] for name in ("spend", "lift")}
    by_store = aggregate(effect.selectExpr("*", *named(tiles)), ["store"], sums)
    return aggregate(per_type(by_store, ["store"], values, config), ["type_no", "markdown_type"], by_type)


def _by_type(contrast: DataFrame) -> DataFrame:
    return aggregate(
        contrast,
        ["type_no", "markdown_type"],
        {
            "stores_measured": ROWS,
            "more_spend": "sum(more_spend)",
            "more_sales": "sum(more_sales)",
            "growth_gap": "avg(top_growth - bottom_growth)",
            "stores_positive": count_where("top_growth > bottom_growth"),
        },
    ).selectExpr("*", f"{ratio('more_sales', 'more_spend')} AS per_dollar")


_SHOWN = {
    "incremental_spend": rounded("more_spend", 0),
    "incremental_sales": rounded("more_sales", 0),
}
_GAP = {"avg_growth_gap_pp": rounded("100D * growth_gap", 1)}


def marginal_lift(effect: DataFrame, config: LiftConfig) -> DataFrame:
    """Extra sales per extra dollar between a store's heavy and light weeks, by type."""
    columns = (
        {"markdown_type": "markdown_type", "stores_measured": "stores_measured"}
        | _SHOWN
        | {"marginal_lift_per_dollar": rounded("per_dollar", 2)}
        | _GAP
        | {"stores_positive": "stores_positive", "marginal_rank": rank_over("per_dollar")}
    )
    by_type = _by_type(_contrast(effect, config))
    return by_type.selectExpr(*named(columns)).orderBy(F.desc("marginal_lift_per_dollar"), "markdown_type")


def marginal_lift_ex_holiday(effect: DataFrame, config: LiftConfig) -> DataFrame:
    """The same with holiday weeks (spend table's flag) left out before tiles are cut."""
    columns = (
        {"markdown_type": "markdown_type"}
        | _SHOWN
        | {"marginal_lift_per_dollar_ex_holiday": rounded("per_dollar", 2)}
        | _GAP
        | {"marginal_rank_ex_holiday": rank_over("per_dollar")}
    )
    by_type = _by_type(_contrast(effect.filter("is_holiday = 0"), config))
    return by_type.selectExpr(*named(columns)).orderBy(F.desc("marginal_lift_per_dollar_ex_holiday"), "markdown_type")


def intensity_confound(spend: DataFrame, config: LiftConfig) -> DataFrame:
    """In a type's heaviest weeks, how many other types are at their heaviest too."""
    heavy = {k: f"tile{k} = {config.tiles}" for k in config.type_numbers}
    weeks = _tiled(spend, "week", config).selectExpr("*", f"{' + '.join(map(flag, heavy.values()))} AS heavy_types")
    sums = {}
    for k, is_heavy in heavy.items():
        sums |= {
            f"weeks_{k}": count_where(is_heavy),
            f"others_{k}": rounded(f"avg(CASE WHEN {is_heavy} THEN heavy_types - 1 END)", 2),
            f"alone_{k}": count_where(f"{is_heavy} AND heavy_types = 1"),
        }
    values = {name: [f"{name}_{k}" for k in config.type_numbers] for name in ("weeks", "others", "alone")}
    columns = {
        "markdown_type": "markdown_type",
        "top_tertile_store_weeks": "weeks",
        "avg_other_types_also_high": "others",
        "pct_weeks_this_type_alone_high": rounded(percent("alone", "weeks"), 1),
    }
    by_type = per_type(aggregate(weeks, [], sums), [], values, config).filter("weeks > 0")
    return by_type.selectExpr(*named(columns)).orderBy("avg_other_types_also_high", "markdown_type")
