"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from promolift import LiftModel, Tables
from promolift.functions.ranking import rank_league
from promolift.operators import base
from promolift.plans.registry import FRAMES, REPORTS, all_queries
from promolift.sources import files
from promolift.sources.testdata import line_totals
from tests.frames import CONFIG, features, stores, train, week, year_before

FOLDER = "/root/testdata/sf0.01"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    """Session settings for one test."""
    before = {}

    def apply(**values):
        for key, value in values.items():
            name = "spark.sql." + key.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield apply
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    sales = [(s, d, day(n), 10 * s + n) for s in (1, 2) for d in (1, 2) for n in range(3) for day in (week, year_before)]
    files.replace_tables(
        {
            "train": train(spark, sales),
            "features": features(spark, [(s, week(n), [n, s, 0, 0, 1]) for s in (1, 2) for n in range(3)]),
            "stores": stores(spark),
        },
        folder,
    )
    return LiftModel(Tables(**files.read_tables(spark, folder)), CONFIG)


def test_both_sides_of_the_pair_push_their_dates(stored, settings):
    settings(autoBroadcastJoinThreshold="-1")
    scans = [line for line in plan(stored.yoy_pair).splitlines() if "FileScan" in line]
    assert len(scans) == 2
    for scan in scans:
        assert "GreaterThanOrEqual(Date" in scan and "LessThan(Date" in scan
        assert re.search(r"PartitionFilters: \[[^\]]*year", scan)
    assert "2010-11-05" in "".join(scans)  # the baseline's own range


def test_scans_read_only_what_a_report_needs(stored):
    text = plan(stored.check_growth_full())
    assert "IsHoliday" not in text and "Weekly_Sales" in text
    assert "MarkDown2" not in plan(stored.spend_store_week.select("md1"))


def test_pairs_shuffle_once_per_side(stored, settings):
    settings(autoBroadcastJoinThreshold="-1")
    assert plan(stored.yoy_pair).count("Exchange hashpartitioning") == 2


def test_spend_is_read_once_to_become_rows(stored):
    text = plan(stored.spend_long)
    assert text.count("FileScan") == 1 and "Union" not in text and "Exchange" not in text


def test_top_departments_need_no_full_sort_or_join_back(stored):
    text = plan(stored.dept_by_type_top())
    assert "TakeOrderedAndProject" in text
    # Pairs twice, spend with baselines, and the two together.
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", text)) == 4


def test_stored_pairs_change_nothing(stored):
    again = stored.with_stored_pairs()
    assert again.tables.pair is not None and "Join" not in plan(again.yoy_pair)
    for name in ("scorecard_by_type", "dept_by_type_top", "marginal_lift"):
        assert getattr(again, name)().collect() == getattr(stored, name)().collect()


def test_league_totals_are_sums_of_sums(stored):
    # Stores per department come from the store x department rows, without an expanded distinct.
    assert "Expand" not in plan(stored.store_dept.groupBy("dept").count())


@pytest.mark.parametrize("name", [*FRAMES, *REPORTS])
def test_no_python_no_cross_join(spark, name):
    text = plan(all_queries()[name](spark, FOLDER))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def _children_of_single_partition(text: str) -> list[str]:
    lines = text.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]


@pytest.mark.parametrize("name", [*FRAMES, *REPORTS])
def test_one_task_only_ever_receives_sums(spark, name):
    """Below a single-partition exchange stands a partial aggregate, or one row per type or count."""
    text = plan(all_queries()[name](spark, FOLDER))
    for child in _children_of_single_partition(text):
        assert re.search(r"HashAggregate|Project|Generate|FileScan parquet", child)
        assert "Sort" not in child
        assert "FileScan" not in child


@pytest.mark.parametrize("name", ["reconcile_lift", "reconcile_alloc", "method_comparison", "scorecard_by_type"])
def test_reports_share_the_stored_sums(spark, settings, name):
    """The pairs are scanned at most once, however many totals a report sets side by side."""
    settings(maxMetadataStringLength="1000")
    assert len(re.findall(r"FileScan[^\n]*/yoy_pair-", plan(all_queries()[name](spark, FOLDER)))) <= 1


def test_leagues_run_nothing_while_they_are_planned(spark, stored):
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        stored.store_league(), stored.dept_league()
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["marginal_lift", "intensity_confound"])
def test_tiles_need_one_shuffle_by_store(stored, settings, name):
    settings(autoBroadcastJoinThreshold="-1")
    text = plan(getattr(stored, name)())
    assert len(re.findall(r"hashpartitioning\(store#\d+, \d+\)", text)) == 1
    above = text.split("ntile")[0]
    assert "Generate" not in text.split("ntile", 1)[1] and above.count("Window") <= 6


def test_both_contrasts_read_everything_once(stored, settings):
    settings(autoBroadcastJoinThreshold="-1")
    text = plan(stored.method_comparison())
    assert text.count("FileScan") == 3  # spend, and sales of both years
    assert len(re.findall(r"hashpartitioning\(store#\d+, \d+\)", text)) == 1


def test_leagues_are_ranked_without_joins(spark, settings):
    settings(autoBroadcastJoinThreshold="-1")
    league = spark.range(100).selectExpr("id AS store", "id % 7 / 3 AS score", "id % 2 AS team")
    ranked = rank_league(league, "score", {"place": (), "team_place": ("team",)})
    text = plan(ranked)
    assert "Join" not in text and len(re.findall(r"Exchange hashpartitioning\(_task#\d+L, \d+\)", text.split("Subqueries")[0])) == 1


def test_lines_are_shuffled_narrow(spark, settings):
    settings(autoBroadcastJoinThreshold="-1")
    text = plan(line_totals(spark, FOLDER))
    scan = next(line for line in text.splitlines() if "l_orderkey" in line and "FileScan" in line)
    assert "l_tax" not in scan and "l_suppkey" not in scan and "l_shipdate" not in scan
    assert text.count("SortMergeJoin") == 3
    assert "partial_sum" in text


def test_a_hot_store_week_is_split(spark, settings):
    """A third of all pairs in one store-week: the skew join takes it apart."""
    settings(
        autoBroadcastJoinThreshold="-1",
        shuffle__partitions="40",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        adaptive__advisoryPartitionSizeInBytes="100KB",
    )
    pair = (
        spark.range(300_000)
        .repartition(16)
        .selectExpr(
            "CAST(if(id % 3 = 0, 0, id % 997) AS INT) AS store",
            "CAST(id AS INT) AS dept",
            "if(id % 3 = 0, DATE'2000-01-03', date_add(DATE'2000-01-03', CAST(7 * (id % 52) AS INT))) AS week",
            "0 AS is_holiday",
            "CAST(id % 1000 AS DECIMAL(18,2)) AS sales_window",
            "CAST(1 + id % 900 AS DECIMAL(18,2)) AS sales_baseline",
            "CAST(1 AS DECIMAL(19,2)) AS lift_dollars",
        )
    )
    shares = base.lift_dept_week(pair).groupBy("store", "dept").agg({"dept_baseline_share": "sum"})
    total = sum(row[2] for row in shares.collect())
    assert abs(total - pair.select("store", "week").distinct().count()) < 1e-6
    assert "skew=true" in plan(shares)
