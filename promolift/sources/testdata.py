"""Weekly sales, spend and store tables derived from an order star schema.

The order tables carry no promotions, so the discount of each line stands in for
promotion spend and the order priority for its type. The one heavy job sums the
lines to store x department x week x type; all three tables follow from it.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift.config import LiftConfig
from promolift.functions.columns import aggregate
from promolift.operators.attribution import store_dept_sums
from promolift.operators.base import clustered, lift_store_week, spend_store_week, yoy_pair
from promolift.sources.staging import Stage

CONFIG = LiftConfig(
    window_start=date(2000, 1, 3),
    window_end=date(2001, 1, 1),
    min_stores=20,
    min_baseline=41_000_000,
    top_departments=3,
)

SPEND_RECORDED_FROM = date(2000, 1, 3)

LINE_SOURCES = ("lineitem", "orders", "customer", "part")


def _path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def source_paths(folder: str) -> list[str]:
    return [_path(folder, name) for name in (*LINE_SOURCES, "nation")]


def monday_of(day: str) -> str:
    return f"next_day(date_sub({day}, 7), 'MO')"


def is_holiday(week: str) -> str:
    """Two holidays fixed in the calendar and two fixed in the ISO week."""
    day = f"(month({week}) * 100 + day({week}))"
    return (
        f"if({day} BETWEEN 628 AND 704 OR {day} BETWEEN 1219 AND 1225 OR weekofyear({week}) IN (6, 47), 1, 0)"
    )


def line_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Lines summed per store, department, week and type.

    Columns are cut to what the sums need before each join, and amounts are
    computed on the lines, so that a shuffled line is two keys and two decimals.
    Sides are broadcast only where Spark finds them small; a key with a large
    part of the lines is split by the skew join, and the sums combine before
    their own shuffle.
    """
    lineitem, orders, customer, part = (spark.read.parquet(_path(folder, name)) for name in LINE_SOURCES)
    sign = "if(l_returnflag = 'R' AND l_quantity > 40, -1D, 1D)"
    lines = lineitem.selectExpr(
        "l_orderkey AS orderkey",
        "l_partkey AS partkey",
        f"CAST({sign} * l_extendedprice AS DECIMAL(18,2)) AS net_sales",
        "CAST(l_discount AS DECIMAL(4,2)) AS discount",
    )
    customers = customer.selectExpr("c_custkey AS custkey", "c_nationkey AS store")
    placed = (
        orders.selectExpr(
            "o_orderkey AS orderkey",
            "o_custkey AS custkey",
            f"{monday_of('CAST(o_orderdate AS DATE)')} AS week",
            "CAST(substr(o_orderpriority, 1, 1) AS INT) AS type_no",
        )
        .join(customers, "custkey")
        .drop("custkey")
    )
    parts = part.selectExpr("p_partkey AS partkey", "p_type AS dept")
    return aggregate(
        lines.join(placed, "orderkey").join(parts, "partkey"),
        ["store", "dept", "week", "type_no"],
        {"net_sales": "sum(net_sales)", "spend": "sum(net_sales * discount)"},
    )


def train_table(totals: DataFrame) -> DataFrame:
    sales = aggregate(totals, ["store", "dept", "week"], {"sales": "sum(net_sales)"})
    return sales.selectExpr(
        "store AS Store",
        "dept AS Dept",
        "week AS Date",
        "CAST(sales AS DECIMAL(18,2)) AS Weekly_Sales",
        f"{is_holiday('week')} AS IsHoliday",
    )


def features_table(
    totals: DataFrame, nation: DataFrame, config: LiftConfig = CONFIG, spend_from: date = SPEND_RECORDED_FROM
) -> DataFrame:
    """Every nation in every week on record, with spend where there was any.

    A nation's calendar runs from the first week to the last, of which the weeks
    on record stay. Spend before ``spend_from`` counts as not recorded.
    """
    weeks = totals.select("week").distinct()
    first, last = (weeks.select(end("week")).scalar() for end in (F.min, F.max))
    calendar = nation.select(F.col("n_nationkey").alias("store"), first.alias("first"), last.alias("last"))
    grid = calendar.selectExpr("store", "explode(sequence(first, last, INTERVAL 7 DAYS)) AS week").join(
        weeks, "week", "left_semi"
    )
    spend = aggregate(
        totals.filter(f"week >= DATE'{spend_from}'"),
        ["store", "week"],
        {
            column: f"CAST(round(sum(CASE WHEN type_no = {k} THEN spend END), 2) AS DECIMAL(18,2))"
            for k, column in zip(config.type_numbers, config.spend_columns)
        },
    )
    return grid.join(spend, ["store", "week"], "left").selectExpr(
        "store AS Store", "week AS Date", *config.spend_columns, f"{is_holiday('week')} AS IsHoliday"
    )


def stores_table(nation: DataFrame) -> DataFrame:
    return nation.selectExpr(
        "n_nationkey AS Store",
        "CASE WHEN n_regionkey <= 1 THEN 'A' WHEN n_regionkey <= 3 THEN 'B' ELSE 'C' END AS Type",
        "CAST(30000 + (n_nationkey * 7919) % 190000 AS INT) AS Size",
    )


class StagedTables:
    """The three tables, the year-on-year pairs and the two sums over them that
    most reports share, each written on first use.

    As with any weekly warehouse table, the heavy join runs once and the reports
    scan what it left. ``stage`` owns what was written.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.stage = Stage(spark)

    def _stage(self, name: str, build, **options) -> DataFrame:
        return self.stage.table(name, build, **options)

    @cached_property
    def nation(self) -> DataFrame:
        return self.spark.read.parquet(_path(self.folder, "nation"))

    @cached_property
    def line_totals(self) -> DataFrame:
        return self._stage("line_totals", lambda: line_totals(self.spark, self.folder))

    @cached_property
    def train(self) -> DataFrame:
        return self._stage("train", lambda: train_table(self.line_totals))

    @cached_property
    def features(self) -> DataFrame:
        return self._stage("features", lambda: features_table(self.line_totals, self.nation))

    @cached_property
    def stores(self) -> DataFrame:
        return stores_table(self.nation)

    @cached_property
    def pair(self) -> DataFrame:
        return self._stage("yoy_pair", lambda: yoy_pair(self.train, CONFIG), layout=clustered)

    @cached_property
    def lift(self) -> DataFrame:
        return self._stage("lift_store_week", lambda: lift_store_week(self.pair))

    @cached_property
    def store_dept(self) -> DataFrame:
        spend = spend_store_week(self.features, CONFIG)
        return self._stage("store_dept", lambda: store_dept_sums(self.pair, spend, CONFIG))
