"""Laws that hold for any input, on random tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from promolift import LiftModel, Tables
from promolift.sources.testdata import CONFIG
from tests.test_random import _tables


@pytest.fixture(scope="module")
def tables(spark):
    sales, spending, shops = _tables(3)
    spend_columns = ", ".join(f"{name} DECIMAL(18,2)" for name in CONFIG.spend_columns)
    return (
        spark.createDataFrame(
            sales, "Store INT, Dept STRING, Date DATE, IsHoliday INT, Weekly_Sales DECIMAL(18,2)"
        ),
        spark.createDataFrame(spending, f"Store INT, Date DATE, IsHoliday INT, {spend_columns}"),
        spark.createDataFrame(shops, "Store INT, Type STRING, Size INT, Band STRING").drop("Band"),
    )


@pytest.fixture(scope="module")
def model(tables):
    return LiftModel(Tables(*tables), CONFIG)


def test_becoming_rows_conserves_spend(model):
    wide = model.spend_store_week.agg(F.sum("total_md_spend"), F.sum("types_active")).first()
    long = model.spend_long.agg(F.sum("spend"), F.sum("is_active")).first()
    assert tuple(wide) == tuple(long)


def test_spend_shares_sum_to_one_or_are_all_null(model):
    per_week = model.spend_long.groupBy("store", "week").agg(
        F.sum("spend").alias("spend"), F.sum("spend_share").alias("share"), F.count("spend_share").alias("known")
    )
    broken = per_week.filter("if(spend > 0, abs(share - 1) > 1e-9 OR known <> 5, known <> 0)")
    assert broken.count() == 0 and per_week.filter("spend = 0").count() > 0


def test_department_shares_sum_to_one_or_are_all_zero(model):
    per_week = model.lift_dept_week.groupBy("store", "week").agg(
        F.sum("dept_baseline_share").alias("share"), F.max("sales_baseline").alias("highest")
    )
    assert per_week.filter("abs(share - if(highest > 0, 1, 0)) > 1e-9").count() == 0


def test_lift_decomposes(model):
    parts = model.reconcile_decomposition().first()
    assert parts["gap"] == 0
    total = model.yoy_pair.agg(F.sum("lift_dollars")).first()[0]
    assert parts["total_yoy_lift"] == float(total)


def test_order_and_partitioning_do_not_matter(tables, model):
    shuffled = LiftModel(
        Tables(*[table.repartition(7).sortWithinPartitions(F.rand(5)) for table in tables]), CONFIG
    )
    for name in ("scorecard_by_type", "type_by_store", "dept_league", "marginal_lift", "intensity_confound"):
        assert getattr(shuffled, name)().collect() == getattr(model, name)().collect()


def test_measures_repeat_the_scorecard(model):
    card = {row.markdown_type: row for row in model.scorecard_by_type().collect()}
    for row in model.measure_type().collect():
        assert round(row.sales_lift_per_dollar, 2) == card[row.markdown_type].sales_lift_per_dollar
    for row in model.measure_index(dims=["markdown_type"]).collect():
        assert round(row.effectiveness_index, 2) == card[row.markdown_type].effectiveness_index
