"""Readers and writers: CSV inputs, Parquet base tables, CSV exports."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

from promolift.config import LiftConfig
from promolift.functions.columns import ROWS, aggregate
from promolift.sources import schemas
from promolift.sources.versions import Versions

TABLES = ("train", "features", "stores")


#: The whole text of a line that does not fit its columns.
BAD_LINE = "_bad_line"
REJECTED = "table_name STRING, file STRING, line_number BIGINT, line STRING"


def _csv(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    # FAILFAST: a value that does not fit its type must not turn into "no spend".
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "NA")
        .option("mode", mode)
        .option("columnNameOfCorruptRecord", BAD_LINE)
        .csv(path)
    )


def _input_schemas(config: LiftConfig, dept_type: str) -> dict[str, str]:
    return {
        "train": schemas.sales_schema(dept_type),
        "features": schemas.features_schema(config),
        "stores": schemas.STORES,
    }


def read_inputs(
    spark: SparkSession, folder: str, config: LiftConfig = LiftConfig(), dept_type: str = "INT"
) -> dict[str, DataFrame]:
    """train.csv, features.csv and stores.csv with fixed types; NA is NULL."""
    return {
        name: _csv(spark, f"{folder}/{name}.csv", schema) for name, schema in _input_schemas(config, dept_type).items()
    }


def write_inputs(tables: dict[str, DataFrame], folder: str, config: LiftConfig = LiftConfig()) -> None:
    """The three tables as CSV in the layout ``read_inputs`` expects; columns they lack are NA."""
    dated = {
        "train": schemas.sales_schema("STRING"),
        "features": schemas.features_schema(config),
    }
    for name in TABLES:
        schema = StructType.fromDDL(dated.get(name, schemas.STORES))
        known = {column.lower() for column in tables[name].columns}
        columns = [
            f"CAST({field.name if field.name.lower() in known else 'NULL'} AS {field.dataType.simpleString()}) "
            f"AS {field.name}"
            for field in schema
        ]
        laid_out = tables[name].selectExpr(*columns)
        laid_out.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(f"{folder}/{name}.csv")


def laid_out(table: DataFrame) -> tuple[DataFrame, list[str]]:
    """A base table as it is stored, and its folder columns: by year where there
    is a Date, so that the window and its baseline read only the directories they need.

    The rebalance step lets adaptive execution even out file sizes and split a
    year that holds most of the rows.
    """
    if "Date" in table.columns:
        return table.withColumn("year", F.year("Date")).hint("rebalance", F.col("year")), ["year"]
    return table, []


def control_amount(table: DataFrame) -> str:
    """What the control total of a base table sums: sales, all spend or sizes."""
    known = [column for column in ("Weekly_Sales", "Size") if column in table.columns]
    spend = [f"coalesce({f.name}, 0)" for f in table.schema if isinstance(f.dataType, DecimalType)]
    return known[0] if known else " + ".join(spend) or "0"


def write_table(table: DataFrame, path: str) -> dict:
    """Write a base table and return its control totals, which are collected while it is written.

    They are taken behind the last shuffle, where a task that is run again counts once.
    """
    stored, folders = laid_out(table)
    written = Observation()
    total = f"CAST(coalesce(sum({control_amount(table)}), 0) AS STRING) AS total"
    stored.observe(written, F.expr(f"{ROWS} AS rows"), F.expr(total)).write.partitionBy(*folders).parquet(path)
    return dict(written.get)


def replace_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Write the base tables as a new version and switch to it when all are written.

    Until then, and if any of them fails, readers find the earlier version whole.
    """
    versions = Versions(next(iter(tables.values())).sparkSession, folder)
    path = versions.begin()
    paths = {name: f"{path}/{name}" for name in tables}
    totals = {name: write_table(table, paths[name]) for name, table in tables.items()}
    versions.commit(path, paths, totals)


def _in_force(spark: SparkSession, folder: str) -> dict:
    found = Versions(spark, folder).current()
    if found is None:
        raise FileNotFoundError(f"no tables in {folder}: nothing was loaded there")
    return found


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the load in force."""
    paths = _in_force(spark, folder)["tables"]
    return {name: spark.read.parquet(paths[name]) for name in TABLES}


def stored_totals(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, rows and total of the load in force, as counted while it was written: no table is read."""
    totals = _in_force(spark, folder)["totals"]
    rows = [(name, found["rows"], Decimal(found["total"])) for name, found in totals.items()]
    return spark.createDataFrame(rows, "table_name STRING, rows BIGINT, total DECIMAL(38,2)")


def verify_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The totals left by the load in force beside those of a scan: table_name, rows, total, rows_gap and total_gap.

    Gaps tell that files were changed, lost or added since.
    """
    scans = [
        aggregate(table, [], {"_rows": ROWS, "_total": f"coalesce(sum({control_amount(table)}), 0)"}).selectExpr(
            f"'{name}' AS table_name", "_rows", "CAST(_total AS DECIMAL(38,2)) AS _total"
        )
        for name, table in read_tables(spark, folder).items()
    ]
    scanned = reduce(DataFrame.unionAll, scans)
    return stored_totals(spark, folder).join(scanned, "table_name").selectExpr(
        "table_name", "rows", "total", "_rows - rows AS rows_gap", "_total - total AS total_gap"
    )


def load_inputs(
    spark: SparkSession,
    source: str,
    folder: str,
    config: LiftConfig = LiftConfig(),
    dept_type: str = "INT",
    most_rejected: float = 0.0,
) -> DataFrame:
    """Load the three CSV files as a new version of the tables: table_name, rows and rejected.

    A line that does not fit its table's columns is left out of it and kept with
    its file and line number in the table ``rejected`` of the version. When more
    than ``most_rejected`` of a table's lines do not fit, the load is refused and
    the earlier version stays in force; the refused version's rejected lines can
    still be read at the path that the error names.

    One pass reads, checks and stores a table. Only files with bad lines are read
    again, to number them.
    """
    versions = Versions(spark, folder)
    path = versions.begin()
    paths, totals, report = {}, {}, []
    rejected_path = f"{path}/rejected"
    for name, schema in _input_schemas(config, dept_type).items():
        lines = _csv(spark, f"{source}/{name}.csv", f"{schema}, {BAD_LINE} STRING", mode="PERMISSIVE")
        seen = Observation()
        with_file = lines.select("*", F.col("_metadata.file_path").alias("_file"))
        checked = with_file.observe(seen, F.expr(f"collect_set(if({BAD_LINE} IS NULL, NULL, _file)) AS bad_files"))
        paths[name] = f"{path}/{name}"
        totals[name] = write_table(checked.where(f"{BAD_LINE} IS NULL").drop(BAD_LINE, "_file"), paths[name])
        bad_files, rejected = list(seen.get["bad_files"]), 0
        if bad_files:
            counted = Observation()
            bad = rejected_lines(spark, bad_files, schema).select(F.lit(name).alias("table_name"), "*")
            bad.observe(counted, F.expr(f"{ROWS} AS rows")).write.mode("append").parquet(rejected_path)
            rejected = counted.get["rows"]
        report.append((name, totals[name]["rows"], rejected))
    for name, rows, rejected in report:
        if rejected > most_rejected * (rows + rejected):
            raise ValueError(
                f"{name}: {rejected} of {rows + rejected} lines do not fit, see {rejected_path}; nothing was replaced"
            )
    if any(rejected for _, _, rejected in report):
        paths["rejected"] = rejected_path
    versions.commit(path, paths, totals)
    return spark.createDataFrame(report, "table_name STRING, rows BIGINT, rejected BIGINT")


def read_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, file, line_number and line of the lines that the load in force left out."""
    path = _in_force(spark, folder)["tables"].get("rejected")
    return spark.read.schema(REJECTED).parquet(path) if path else spark.createDataFrame([], REJECTED)


def rejected_lines(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """file, line_number and line of the lines of CSV files that do not fit the schema.

    Lines are numbered in two levels: the blocks of a file are counted, and a line's
    number is that of the lines in earlier blocks and its place in its own.
    """
    lines = spark.read.text(paths).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    blocks = aggregate(lines, ["file", "block"], {"_rows": ROWS, "_first": "min(place)"}).selectExpr(
        "file AS _of", "block AS _at", "sum(_rows) OVER (PARTITION BY file ORDER BY block) - _rows - _first AS _lag"
    )
    options = {"nullValue": "NA", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    parsed = F.from_csv("line", f"{schema}, {BAD_LINE} STRING", options)[BAD_LINE]
    numbered = lines.join(blocks, F.expr("file = _of AND block = _at")).selectExpr(
        "file", "_lag + place + 1 AS line_number", "line"
    )
    return numbered.where("line_number > 1 AND trim(line) <> ''").where(parsed.isNotNull())


def load_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    counts = [
        aggregate(table, [], {"rows": ROWS}).selectExpr(f"'{name}' AS table_name", "rows")
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def export_csv(facts: dict[str, DataFrame], folder: str) -> None:
    for name, fact in facts.items():
        fact.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def read_exports(spark: SparkSession, folder: str, dept_type: str = "INT") -> dict[str, DataFrame]:
    return {
        name: _csv(spark, f"{folder}/{name}", schema)
        for name, schema in schemas.export_schemas(dept_type).items()
    }
