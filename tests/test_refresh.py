from __future__ import annotations

import random
from pathlib import Path

import pytest

from promolift import LiftModel, Tables
from promolift.operators.base import lift_dept_week, lift_store_week, yoy_pair
from promolift.sources.refresh import WeeklyPairs
from tests.frames import CONFIG, week, year_before

SCHEMA = "Store INT, Dept INT, Date DATE, Weekly_Sales DECIMAL(18,2), IsHoliday BOOLEAN"
WEEKS = 5


def sales(spark, rows):
    return spark.createDataFrame([(s, d, day, None if v is None else v, h) for s, d, day, v, h in rows], SCHEMA)


def _decimal(value):
    from decimal import Decimal

    return Decimal(value)


def _rows(seed):
    random.seed(seed)
    days = [day(n) for n in range(WEEKS) for day in (week, year_before)]
    return [
        (store, dept, day, _decimal(random.randint(-50, 500)), random.random() < 0.2)
        for store in range(3) for dept in range(4) for day in days if random.random() < 0.8
    ]


def _same(stored, train):
    pair = yoy_pair(train, CONFIG)
    wanted = {"yoy_pair": pair, "lift_store_week": lift_store_week(pair), "lift_dept_week": lift_dept_week(pair)}
    for name, frame in wanted.items():
        assert stored[name].columns == frame.columns
        assert sorted(map(str, stored[name].collect())) == sorted(map(str, frame.collect())), name


def _actions(report):
    return {row.week: row.action for row in report.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_increments_equal_a_rebuild(spark, tmp_path, seed):
    """Random changes, additions, repeats and removals; the weeks written follow the weeks changed."""
    rows = _rows(seed)
    weekly = WeeklyPairs(spark, str(tmp_path / "pairs"), CONFIG)
    weekly.refresh(sales(spark, rows))
    for step in range(3):
        day = random.choice([week(random.randrange(WEEKS)), year_before(random.randrange(WEEKS))])
        of_day = [k for k, row in enumerate(rows) if row[2] == day]
        change = random.choice(["value", "repeat", "add", "remove", "flag"])
        for k in sorted(of_day[:2] if change != "remove" else of_day, reverse=True):
            s, d, _, value, holiday = rows[k]
            rows[k] = (s, d, day, value + (change == "value"), holiday != (change == "flag"))
            if change == "repeat":
                rows.append(rows[k])
            if change == "add":
                rows.append((9, 9, day, _decimal(step), False))
            if change == "remove":
                del rows[k]
        train = sales(spark, rows)
        actions = _actions(weekly.refresh(train))
        touched = {day, weekly._offset(day)}
        assert {w for w, action in actions.items() if action != "kept"} <= touched
        _same(weekly.frames(train), train)


def test_weeks_that_did_not_change_are_not_written(spark, tmp_path):
    rows = _rows(7)
    weekly = WeeklyPairs(spark, str(tmp_path / "pairs"), CONFIG)
    weekly.refresh(sales(spark, rows))
    assert set(_actions(weekly.refresh(sales(spark, rows[::-1]))).values()) == {"kept"}  # order does not matter
    changed = [(s, d, day, value + (day == week(2)), h) for s, d, day, value, h in rows]
    train = sales(spark, changed)
    assert [w for w, action in _actions(weekly.refresh(train)).items() if action == "built"] == [week(2)]
    newest = sorted((tmp_path / "pairs").glob("version-*"))[-1]
    for name in ("yoy_pair", "lift_store_week", "lift_dept_week"):
        assert [path.name for path in (newest / name).glob("of_week=*")] == [f"of_week={week(2)}"]
    files = {Path(path.removeprefix("file://")).parts[-4] for path in weekly.frames(train)["yoy_pair"].inputFiles()}
    assert len(files) == 2
    _same(weekly.frames(train), train)


def test_versions_that_hold_weeks_in_use_stay(spark, tmp_path):
    rows = _rows(3)
    weekly = WeeklyPairs(spark, str(tmp_path / "pairs"), CONFIG)
    for step in range(5):
        train = sales(spark, [(s, d, day, value + step * (day == week(0)), h) for s, d, day, value, h in rows])
        weekly.refresh(train)
    assert len(list((tmp_path / "pairs").glob("version-*"))) == 3  # the first, and two of the week that changes
    _same(weekly.frames(train), train)


def test_a_refresh_that_fails_leaves_the_old_pairs(spark, tmp_path, monkeypatch):
    rows = _rows(4)
    weekly = WeeklyPairs(spark, str(tmp_path / "pairs"), CONFIG)
    train = sales(spark, rows)
    weekly.refresh(train)

    def fail(*_):
        raise OSError("disk full")

    monkeypatch.setattr(weekly.versions, "commit", fail)
    more = sales(spark, [(s, d, day, value * 2, h) for s, d, day, value, h in rows])
    with pytest.raises(OSError):
        weekly.refresh(more)
    monkeypatch.undo()
    _same(weekly.frames(train), train)
    weekly.refresh(more)
    _same(weekly.frames(more), more)


def test_empty_sales_and_other_settings(spark, tmp_path):
    import dataclasses

    weekly = WeeklyPairs(spark, str(tmp_path / "pairs"), CONFIG)
    train = sales(spark, [])
    assert weekly.refresh(train).count() == 0 and weekly.frames(train)["yoy_pair"].count() == 0
    train = sales(spark, _rows(5))
    weekly.refresh(train)
    removed = _actions(weekly.refresh(sales(spark, [])))
    assert set(removed.values()) == {"removed"}
    weekly.refresh(train)
    shifted = dataclasses.replace(CONFIG, offset_days=7)
    other = WeeklyPairs(spark, str(tmp_path / "pairs"), shifted)
    other.refresh(train)
    pair = yoy_pair(train, shifted)
    assert sorted(map(str, other.frames(train)["yoy_pair"].collect())) == sorted(map(str, pair.collect()))


def test_a_model_over_refreshed_pairs_reports_the_same(spark, tmp_path):
    from tests.frames import model

    given = model(
        spark,
        [(1, 1, week(0), 140.25), (1, 1, year_before(0), 100.5), (2, 5, week(0), 3), (2, 5, year_before(0), 1)],
        [(1, week(0), [10, 30, 0, 0, 0]), (2, week(0), [0, 0, 0, 0, 1.5])],
    )
    refreshed = given.with_refreshed_pairs(str(tmp_path / "pairs"))
    for name in ("scorecard_by_type", "dept_league", "check_growth_full"):
        assert getattr(refreshed, name)().collect() == getattr(given, name)().collect()
    assert isinstance(refreshed, LiftModel) and isinstance(refreshed.tables, Tables)
