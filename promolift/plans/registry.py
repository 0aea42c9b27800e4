"""Every query by name, over tables derived from an order star schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift.functions.columns import ROWS, aggregate, published, rounded
from promolift.plans.model import LiftModel
from promolift.sources import files, testdata
from promolift.sources.refresh import WeeklyPairs
from promolift.sources.staging import new_path, state_of

# Frames defined without rounding: the digits to show them with.
UNROUNDED = {
    "spend_long": 6,
    "lift_dept_week": 6,
    "fact_type_lift": 4,
    "fact_type_spend": 4,
    "measure_type": 4,
    "measure_index": 4,
    "measure_dept": 4,
    "measure_yoy": 6,
    "measure_format_type": 4,
    "measure_holiday_split": 4,
}

FRAMES = (
    "spend_store_week",
    "spend_long",
    "yoy_pair",
    "lift_store_week",
    "lift_dept_week",
    "fact_type_lift",
    "fact_dept_sales",
    "fact_type_spend",
    "dim_store",
)

REPORTS = (
    "check_window_shape",
    "check_null_rate_by_month",
    "check_coactivity",
    "check_zero_spend_weeks",
    "check_activity_by_type",
    "check_negative_spend",
    "check_baseline_weeks",
    "check_holiday_alignment",
    "check_pair_coverage",
    "check_drift_zero_spend",
    "check_growth_full",
    "check_baseline_spend",
    "scorecard_by_type",
    "scorecard_by_type_holiday",
    "scorecard_measured_drift",
    "store_league",
    "type_by_format",
    "type_by_store",
    "dept_league",
    "dept_by_type_top",
    "dept_cut_list",
    "marginal_lift",
    "marginal_lift_ex_holiday",
    "intensity_confound",
    "measure_type",
    "measure_index",
    "measure_dept",
    "measure_yoy",
    "measure_format_type",
    "measure_holiday_split",
    "measure_holiday_share",
    "load_report",
    "profile_tables",
    "profile_formats",
    "check_join_integrity",
    "check_null_rate_overall",
    "check_key_uniqueness",
    "check_holiday_consistency",
    "reconcile_spend",
    "reconcile_lift",
    "reconcile_alloc",
    "reconcile_decomposition",
    "drift_charge",
    "method_comparison",
)


_models: WeakKeyDictionary[SparkSession, dict] = WeakKeyDictionary()


def model_for(spark: SparkSession, folder: str) -> LiftModel:
    """One model per session and folder, for the present state of the source files.

    Input tables are built on first use: no report pays for one it does not read.
    When the source files change, what the model had written is deleted.
    """
    models = _models.setdefault(spark, {})
    state = state_of(spark, testdata.source_paths(folder))
    known = models.get(folder)
    if known is None or known[0] != state:
        if known is not None:
            known[1].tables.stage.drop()
        models[folder] = state, LiftModel(testdata.StagedTables(spark, folder), testdata.CONFIG)
    return models[folder][1]


def _job_path(model: LiftModel, name: str) -> str:
    """A new folder for a job that writes files; the files of its last run are deleted."""
    path = new_path(model.tables.spark, name)
    model.tables.stage.replace(name, path)
    return path


def report(model: LiftModel, name: str) -> DataFrame:
    """One query over any model, in plain output types."""
    result = getattr(model, name)
    return published(result if name in FRAMES else result(), UNROUNDED.get(name))


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return report(model_for(spark, folder), name)

    run.__name__ = name
    return run


def _totals(tables: dict[str, DataFrame], amounts: dict[str, str]) -> DataFrame:
    """Row count and one control total per table."""
    counted = [
        aggregate(tables[name], [], {"rows": ROWS, "total": rounded(f"sum({amount})", 2)}).selectExpr(
            f"'{name}' AS table_name", "*"
        )
        for name, amount in amounts.items()
    ]
    return published(reduce(DataFrame.unionAll, counted))


def csv_to_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The inputs as CSV, read with fixed types, stored as tables by year, and counted."""
    model = model_for(spark, folder)
    target = _job_path(model, "csv_to_tables")
    inputs = {name: getattr(model, name) for name in files.TABLES}
    files.write_inputs(inputs, f"{target}/csv", model.config)
    files.replace_tables(files.read_inputs(spark, f"{target}/csv", model.config, "STRING"), f"{target}/tables")
    spend = " + ".join(f"coalesce({column}, 0)" for column in model.config.spend_columns)
    return _totals(
        files.read_tables(spark, f"{target}/tables"), {"train": "Weekly_Sales", "features": spend, "stores": "Size"}
    )


def load_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The control totals that storing the base tables leaves, beside those of a scan of what was stored."""
    model = model_for(spark, folder)
    target = _job_path(model, "load_totals")
    files.replace_tables({name: getattr(model, name) for name in files.TABLES}, target)
    return published(files.verify_tables(spark, target))


def load_with_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The inputs as CSV, with dates that are none in the holiday weeks of some stores: lines stored and rejected, and
    the control total of those stored."""
    model = model_for(spark, folder)
    target = _job_path(model, "load_with_rejects")
    inputs = {name: getattr(model, name) for name in files.TABLES}
    files.write_inputs(inputs, f"{target}/csv", model.config)
    date = "if(IsHoliday = 1 AND Store % 5 = 0, 'never', CAST(Date AS STRING)) AS Date"
    spoiled = inputs["train"].selectExpr("Store", "Dept", date, "Weekly_Sales", "IsHoliday = 1 AS IsHoliday")
    spoiled.write.mode("overwrite").option("header", True).csv(f"{target}/csv/train.csv")
    files.load_inputs(spark, f"{target}/csv", f"{target}/tables", model.config, "STRING", most_rejected=1.0)
    bad = aggregate(files.read_rejected(spark, f"{target}/tables"), ["table_name"], {"rejected": ROWS})
    stored = files.stored_totals(spark, f"{target}/tables").join(bad, "table_name", "left").fillna(0, ["rejected"])
    return published(stored.select("table_name", "rows", "rejected", "total"))


def refresh_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs stored for sales that are wrong in the first week of each month, then refreshed from the right ones: what
    the refresh did with each week, and the sums of the stored pairs."""
    model = model_for(spark, folder)
    weekly = WeeklyPairs(spark, _job_path(model, "refresh_weeks"), model.config)
    wrong = "CAST(if(day(Date) <= 7, 2 * Weekly_Sales, Weekly_Sales) AS DECIMAL(18,2))"
    weekly.refresh(model.train.withColumn("Weekly_Sales", F.expr(wrong)))
    report = weekly.refresh(model.train)
    stored = weekly.frames(model.train)
    sums = {name: rounded(f"sum({name})", 2) for name in ("sales_window", "sales_baseline")}
    pairs = aggregate(stored["yoy_pair"], ["week"], sums)
    lift = aggregate(stored["lift_store_week"], ["week"], {"lift": rounded("sum(lift_dollars)", 2)})
    shares = aggregate(stored["lift_dept_week"], ["week"], {"shares": rounded("sum(dept_baseline_share)", 6)})
    return published(report.join(pairs, "week").join(lift, "week").join(shares, "week"))


def export_and_reload(spark: SparkSession, folder: str) -> DataFrame:
    """The four exported facts as CSV, read back with their types, and counted."""
    model = model_for(spark, folder)
    target = _job_path(model, "export_and_reload")
    files.export_csv(model.exports(), target)
    return _totals(
        files.read_exports(spark, target, "STRING"),
        {
            "fact_markdown_lift": "allocated_spend",
            "fact_dept_sales": "yoy_lift_dollars",
            "fact_markdown_spend": "total_spend",
            "dim_store": "store_size_sqft",
        },
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {name: _query(name) for name in (*FRAMES, *REPORTS)}
    jobs = (csv_to_tables, load_totals, load_with_rejects, refresh_weeks, export_and_reload)
    return named | {job.__name__: job for job in jobs}
