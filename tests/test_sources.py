from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from promolift import LiftConfig, LiftModel, Tables
from promolift.__main__ import main, parser
from promolift.plans.registry import all_queries, model_for
from promolift.sources import files, staging, testdata
from promolift.sources.schemas import export_schemas
from promolift.sources.versions import Versions
from tests.frames import CONFIG, by, model, rows, week, year_before

FOLDER = "/root/testdata/sf0.001"


def _write_inputs(folder):
    (folder / "train.csv").write_text(
        "Store,Dept,Date,Weekly_Sales,IsHoliday\n1,1,2011-11-04,140.5,FALSE\n1,1,2010-11-05,100,FALSE\n"
        "1,2,2011-11-25,7,TRUE\n"
    )
    (folder / "features.csv").write_text(
        "Store,Date,Temperature,Fuel_Price,MarkDown1,MarkDown2,MarkDown3,MarkDown4,MarkDown5,CPI,Unemployment,IsHoliday\n"
        "1,2011-11-04,42.3,2.572,10.25,NA,-3,NA,30.1,211.09,8.106,FALSE\n"
        "1,2010-11-05,42.3,2.572,NA,NA,NA,NA,NA,NA,NA,FALSE\n"
    )
    (folder / "stores.csv").write_text("Store,Type,Size\n1,A,151315\n2,B,37392\n")


def test_csv_inputs_are_typed_and_na_is_null(spark, tmp_path):
    _write_inputs(tmp_path)
    tables = files.read_inputs(spark, str(tmp_path))
    assert dict(tables["train"].dtypes)["Weekly_Sales"] == "decimal(18,2)"
    assert dict(tables["train"].dtypes)["Date"] == "date"
    first = by(tables["features"], "Date")[week(0)]
    assert first["MarkDown2"] is None and float(first["MarkDown1"]) == 10.25
    assert rows(tables["train"].filter("IsHoliday"))[0]["Dept"] == 2


def test_a_value_that_does_not_fit_stops_the_load(spark, tmp_path):
    _write_inputs(tmp_path)
    path = tmp_path / "train.csv"
    path.write_text(path.read_text() + "1,3,2011-11-04,many,FALSE\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|[Mm]alformed"):
        files.read_inputs(spark, str(tmp_path))["train"].collect()


def test_tables_are_replaced_reported_and_modelled(spark, tmp_path):
    _write_inputs(tmp_path)
    target = str(tmp_path / "tables")
    inputs = files.read_inputs(spark, str(tmp_path))
    files.replace_tables(inputs, target)
    files.replace_tables(inputs, target)
    tables = files.read_tables(spark, target)
    assert {r["table_name"]: r["rows"] for r in rows(files.load_report(tables))} == {
        "train": 3,
        "features": 2,
        "stores": 2,
    }
    card = by(LiftModel(Tables(**tables), LiftConfig()).scorecard_by_type(), "markdown_type")
    assert card["Markdown Type 5"]["total_spend"] == 30.0
    version = Path(tables["train"].inputFiles()[0].removeprefix("file://")).parents[1]
    assert {p.name for p in version.glob("year=*")} == {"year=2010", "year=2011"}
    assert {r["table_name"]: float(r["total"]) for r in rows(files.stored_totals(spark, target))} == {
        "train": 247.5,
        "features": 37.35,
        "stores": 188707,
    }


def test_totals_of_a_load_tell_lost_files(spark, tmp_path):
    _write_inputs(tmp_path)
    target = str(tmp_path / "tables")
    files.replace_tables(files.read_inputs(spark, str(tmp_path)), target)
    assert all(row.rows_gap == 0 and row.total_gap == 0 for row in files.verify_tables(spark, target).collect())
    for part in (tmp_path / "tables").glob("version-*/train/year=2010/*.parquet"):
        part.unlink()
    gaps = by(files.verify_tables(spark, target), "table_name")
    assert (gaps["train"]["rows_gap"], float(gaps["train"]["total_gap"])) == (-1, -100.0)
    assert gaps["features"]["rows_gap"] == 0


def test_stored_totals_read_no_table(spark, tmp_path):
    _write_inputs(tmp_path)
    target = str(tmp_path / "tables")
    files.replace_tables(files.read_inputs(spark, str(tmp_path)), target)
    assert "FileScan" not in files.stored_totals(spark, target)._jdf.queryExecution().toString()


def _loaded(spark, folder):
    return {name: table.count() for name, table in files.read_tables(spark, folder).items()}


def test_a_load_that_fails_midway_leaves_the_tables_as_they_were(spark, tmp_path):
    _write_inputs(tmp_path)
    target = str(tmp_path / "tables")
    inputs = files.read_inputs(spark, str(tmp_path))
    files.replace_tables(inputs, target)
    before = _loaded(spark, target)
    broken = inputs["stores"].withColumn("Size", F.raise_error(F.lit("disk full")).cast("int"))
    more = inputs["train"].union(inputs["train"])
    with pytest.raises(Exception, match="disk full"):
        files.replace_tables({"train": more, "features": inputs["features"], "stores": broken}, target)
    assert len(list((tmp_path / "tables").glob("version-*"))) == 2  # the failed one was half written
    assert _loaded(spark, target) == before
    open_reader = files.read_tables(spark, target)["train"]
    files.replace_tables(inputs | {"train": more}, target)
    assert _loaded(spark, target) == before | {"train": 6} and open_reader.count() == 3
    files.replace_tables(inputs, target)
    files.replace_tables(inputs, target)
    left = sorted(path.name for path in (tmp_path / "tables").iterdir() if not path.name.startswith("."))
    assert [name.split("-")[0] for name in left] == ["current"] * 2 + ["version"] * 2 and _loaded(spark, target) == before


def test_of_two_loads_at_once_one_fails(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    first, second = versions.begin(), versions.begin()
    versions.commit(first, {}, {})
    with pytest.raises(Exception, match="exist"):
        versions.commit(second, {}, {})
    assert versions.current()["folder"] == first
    with pytest.raises(FileNotFoundError):
        files.read_tables(spark, str(tmp_path / "nothing"))


def _spoil(folder):
    with open(folder / "train.csv", "a") as out:
        out.write("1,3,2011-11-04,many,FALSE\n\n2,4,2011-11-11,9.99,TRUE\n2,x\n2,5,2011-11-11,NA,FALSE,more\n")


def test_lines_that_do_not_fit_are_kept_with_their_place(spark, tmp_path):
    _write_inputs(tmp_path)
    _spoil(tmp_path)
    target = str(tmp_path / "tables")
    report = files.load_inputs(spark, str(tmp_path), target, most_rejected=0.5)
    assert {row.table_name: (row.rows, row.rejected) for row in report.collect()} == {
        "train": (4, 3), "features": (2, 0), "stores": (2, 0)
    }
    bad = rows(files.read_rejected(spark, target))
    assert sorted((row["line_number"], row["line"]) for row in bad) == [
        (5, "1,3,2011-11-04,many,FALSE"), (8, "2,x"), (9, "2,5,2011-11-11,NA,FALSE,more")
    ]
    assert {(row["table_name"], Path(row["file"]).name) for row in bad} == {("train", "train.csv")}
    train = files.read_tables(spark, target)["train"]
    assert train.where("Weekly_Sales IS NULL").count() == 0 and "year" in train.columns
    assert set(train.columns) == {"Store", "Dept", "Date", "Weekly_Sales", "IsHoliday", "year"}


def test_too_many_bad_lines_refuse_the_load(spark, tmp_path):
    _write_inputs(tmp_path)
    target = str(tmp_path / "tables")
    files.load_inputs(spark, str(tmp_path), target)
    _spoil(tmp_path)
    with pytest.raises(ValueError, match="3 of 7 lines") as refused:
        files.load_inputs(spark, str(tmp_path), target, most_rejected=0.4)
    assert _loaded(spark, target)["train"] == 3 and files.read_rejected(spark, target).count() == 0
    path = str(refused.value).split("see ")[1].split(";")[0]
    assert spark.read.parquet(path).count() == 3


def test_lines_are_numbered_over_blocks_of_a_file(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("Store,Type,Size\n" + "".join(f"{k},A,{'x' if k % 997 == 0 else k}\n" for k in range(1, 20_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 4
        bad = files.rejected_lines(spark, [str(path)], "Store INT, Type STRING, Size INT").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(row.line_number for row in bad) == [k + 1 for k in range(997, 20_001, 997)]


def test_exports_come_back_with_their_types(spark, tmp_path):
    m = model(
        spark,
        [(1, 1, week(0), 140.25), (1, 1, year_before(0), 100.5), (2, 5, week(0), 3), (2, 5, year_before(0), 1)],
        [(1, week(0), [10.01, 30, 0, 0, 0]), (2, week(0), [0, 0, 0, 0, 1.5])],
    )
    files.export_csv(m.exports(), str(tmp_path))
    back = files.read_exports(spark, str(tmp_path))
    assert set(back) == set(export_schemas())
    for name, fact in m.exports().items():
        assert back[name].columns == fact.columns
        assert sorted(map(tuple, back[name].collect())) == sorted(map(tuple, fact.collect()))
    assert (tmp_path / "dim_store").glob("*.csv")
    kinds = dict(back["fact_markdown_spend"].dtypes)
    assert kinds["store"] == "int" and kinds["total_spend"].startswith("decimal")


def test_derived_tables(spark):
    staged = testdata.StagedTables(spark, FOLDER)
    assert staged.train.count() == 4158
    assert staged.features.count() == 8575
    assert staged.train.filter("Weekly_Sales <= 0").count() == 248
    assert staged.features.filter("Date < DATE'2000-01-03' AND MarkDown1 IS NOT NULL").count() == 0


def test_state_follows_files_at_any_depth(spark, tmp_path):
    source = tmp_path / "source"
    spark.range(3).withColumn("p", F.lit(1)).write.partitionBy("p").parquet(str(source))
    before = staging.state_of(spark, [str(source)])
    assert staging.state_of(spark, [str(source)]) == before
    spark.range(2).write.parquet(str(tmp_path / "more"))
    part = next((tmp_path / "more").glob("*.parquet"))
    shutil.copyfile(part, source / "p=1" / "part-later.parquet")
    assert staging.state_of(spark, [str(source)]) != before


def test_staging_uses_a_folder_that_is_shared(spark):
    folder = staging.shared_folder(spark)
    assert staging.new_path(spark, "x").startswith(f"{folder}/promolift/")
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert folder == (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def test_a_stage_deletes_what_it_wrote(spark):
    stage = staging.Stage(spark)
    assert stage.table("copy", lambda: spark.range(3)).count() == 3
    first = Path(stage.paths["copy"].removeprefix("file:"))
    assert stage.table("copy", lambda: spark.range(5)).count() == 5
    second = Path(stage.paths["copy"].removeprefix("file:"))
    assert not first.exists() and second.exists()
    stage.drop()
    assert not second.exists() and not stage.paths


def _copy_tables(scale: str, folder: Path, names=(*testdata.LINE_SOURCES, "nation")) -> None:
    for name in names:
        shutil.copyfile(Path("/root/testdata") / scale / f"{name}.parquet", folder / f"{name}.parquet")


def test_queries_follow_changed_source_files(spark, tmp_path):
    _copy_tables("sf0.001", tmp_path)
    query = all_queries()["check_growth_full"]
    assert query(spark, str(tmp_path)).first()["store_dept_weeks"] == 49
    written = dict(model_for(spark, str(tmp_path)).tables.stage.paths)
    _copy_tables("sf0.01", tmp_path, testdata.LINE_SOURCES)
    assert query(spark, str(tmp_path)).first()["store_dept_weeks"] == 2708
    assert not any(Path(path.removeprefix("file:")).exists() for path in written.values())


def test_rows_appended_deep_in_a_source_count(spark, tmp_path):
    _copy_tables("sf0.001", tmp_path, ("orders", "customer", "part", "nation"))
    lines = tmp_path / "lineitem.parquet" / "day=1"
    lines.mkdir(parents=True)
    source = Path(FOLDER) / "lineitem.parquet"
    shutil.copyfile(source, lines / "part-0.parquet")
    query = all_queries()["check_growth_full"]
    once = query(spark, str(tmp_path)).first()["window_sales"]
    shutil.copyfile(source, lines / "part-1.parquet")
    assert abs(query(spark, str(tmp_path)).first()["window_sales"] - 2 * once) <= 1  # whole dollars


@pytest.mark.parametrize("name", ["store_league", "csv_to_tables", "export_and_reload"])
def test_a_second_call_leaves_no_more_folders(spark, name):
    root = Path(staging.new_path(spark, "x").removeprefix("file:")).parent
    all_queries()[name](spark, FOLDER).collect()
    before = len(list(root.iterdir()))
    all_queries()[name](spark, FOLDER).collect()
    assert len(list(root.iterdir())) == before


def test_command_line_writes_whole_reports(spark, tmp_path):
    source = model_for(spark, "/root/testdata/sf0.01").tables
    files.replace_tables({name: getattr(source, name) for name in files.TABLES}, str(tmp_path / "tables"))
    config = testdata.CONFIG
    options = [f"--window-start={config.window_start}", f"--window-end={config.window_end}", "--top-departments=2"]
    names = ["fact_type_lift", "dept_by_type_top"]
    assert main(["report", str(tmp_path / "tables"), str(tmp_path / "out"), *names, *options]) == 0
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / "out" / name))
    assert read("fact_type_lift").count() == 747
    assert read("dept_by_type_top").select("dept").distinct().count() == 2


def test_every_setting_is_an_option():
    chosen = parser().parse_args(["report", "a", "b", "--spend-columns=x,y", "--size-bands=9:Big", "--drift-rate=0.5"])
    assert chosen.spend_columns == ("x", "y") and chosen.size_bands == ((9, "Big"),) and chosen.drift_rate == 0.5
    assert chosen.window_start == LiftConfig().window_start
