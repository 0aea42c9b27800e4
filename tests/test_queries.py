"""Every registered query against its SQL counterpart, values and types exactly equal."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from check_oracles import compare, connect
from oracles import all_oracles
from promolift.plans.registry import all_queries

FOLDER = "/root/testdata/sf0.01"

# Measured once on the test tables: name -> rows at sf0.01.
ROWS = {
    "spend_store_week": 1300,
    "spend_long": 6500,
    "yoy_pair": 2708,
    "lift_store_week": 869,
    "lift_dept_week": 2708,
    "check_null_rate_by_month": 73,
    "check_coactivity": 6,
    "check_zero_spend_weeks": 51,
    "check_holiday_alignment": 4,
    "store_league": 25,
    "type_by_store": 125,
    "dept_by_type_top": 15,
    "dept_cut_list": 1,
    "fact_type_lift": 747,
    "fact_dept_sales": 150,
    "fact_type_spend": 125,
    "dim_store": 25,
}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, duck, name):
    frame = entry_points.queries()[name](spark, FOLDER)
    assert compare(frame, duck.sql(entry_points.oracle_sql()[name])) is None


@pytest.mark.parametrize("name", sorted(ROWS))
def test_known_row_counts(spark, name):
    assert entry_points.queries()[name](spark, FOLDER).count() == ROWS[name]


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(entry_points.queries())


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.count() == 5
    assert result.columns[0] == "markdown_type"


def test_scorecard_at_small_scale(spark):
    """lift per dollar, index, rank and label of each type."""
    rows = entry_points.queries()["scorecard_by_type"](spark, FOLDER).collect()
    seen = {
        row.markdown_type[-1]: (
            row.sales_lift_per_dollar,
            row.effectiveness_index,
            row.effectiveness_rank,
            row.recommendation,
        )
        for row in rows
    }
    assert seen == {
        "4": (0.82, 1.68, 1, "Double down"),
        "3": (0.53, 1.08, 2, "Hold"),
        "2": (0.49, 1.01, 3, "Hold"),
        "1": (0.44, 0.90, 4, "Hold"),
        "5": (0.12, 0.25, 5, "Reduce"),
    }
