from __future__ import annotations

from tests.frames import by, model, rows, week, year_before


def _model(spark):
    return model(
        spark,
        [
            (1, 1, week(0), 110),
            (1, 1, year_before(0), 100),
            (1, 2, week(0), 60),
            (1, 1, week(3), 90, True),
            (1, 1, year_before(3), 80),
            (2, 1, week(0), 40),
            (2, 1, year_before(0), 50),
        ],
        [
            (1, week(0), [10, None, -3, 0, 30]),
            (1, week(3), [None, None, None, None, 8], True),
            (2, week(0), [None, 0, 0, 0, 0]),
            (1, week(-40), [None] * 5),
            (1, week(60), [9] * 5),
        ],
    )


def test_spend_checks(spark):
    m = _model(spark)
    shape = rows(m.check_window_shape())[0]
    assert (shape["store_weeks"], shape["stores"], shape["weeks"]) == (3, 2, 2)
    assert (shape["first_week"], shape["last_week"]) == (week(0), week(3))

    months = by(m.check_null_rate_by_month(), "month")
    # Rows before the window count, rows after it do not.
    assert months["2011-01"]["md1_pct_null"] == 100.0
    assert months["2011-11"]["store_weeks"] == 3
    assert months["2011-11"]["md1_pct_null"] == 66.7
    assert max(months) == "2011-11"
    assert rows(m.check_null_rate_overall())[0]["md1_pct_null"] == 75.0

    assert {r["types_active"]: r["store_weeks"] for r in rows(m.check_coactivity())} == {0: 1, 1: 1, 2: 1}
    assert rows(m.check_zero_spend_weeks())[0]["stores_with_no_markdown"] == 1
    assert [r["md3_negative_weeks"] for r in rows(m.check_negative_spend())] == [1]

    fifth = by(m.check_activity_by_type(), "markdown_type")["Markdown Type 5"]
    assert (fifth["active_store_weeks"], fifth["total_spend"], fifth["avg_spend_per_active_week"]) == (2, 38.0, 19.0)
    second = by(m.check_activity_by_type(), "markdown_type")["Markdown Type 2"]
    assert second["avg_spend_per_active_week"] is None


def test_baseline_checks(spark):
    m = _model(spark)
    weeks = rows(m.check_baseline_weeks())[0]
    assert (weeks["window_weeks"], weeks["matched_baseline_weeks"]) == (2, 2)
    assert (weeks["earliest_baseline_week"], weeks["latest_baseline_week"]) == (year_before(0), year_before(3))

    differing = rows(m.check_holiday_alignment())
    assert [(r["window_week"], r["window_is_holiday"], r["baseline_is_holiday"]) for r in differing] == [(week(3), 1, 0)]

    coverage = rows(m.check_pair_coverage())[0]
    assert (coverage["window_rows"], coverage["matched_rows"], coverage["unmatched_rows"]) == (4, 3, 1)
    assert coverage["pct_matched"] == 75.0


def test_growth_and_drift(spark):
    m = _model(spark)
    full = rows(m.check_growth_full())[0]
    assert (full["store_dept_weeks"], full["window_sales"], full["yoy_growth_rate"]) == (3, 240.0, 0.0435)
    drift = rows(m.check_drift_zero_spend())[0]
    assert (drift["store_dept_weeks"], drift["yoy_drift_rate"]) == (1, -0.2)
    charge = rows(m.drift_charge())[0]
    assert (charge["baseline_sales"], charge["measured_lift"], charge["drift_charge"]) == (230.0, 10.0, 14.0)


def test_drift_is_null_without_zero_spend_weeks(spark):
    m = model(spark, [(1, 1, week(0), 2), (1, 1, year_before(0), 1)], [(1, week(0), [1] * 5)])
    drift = rows(m.check_drift_zero_spend())[0]
    assert drift["store_dept_weeks"] == 0
    assert drift["window_sales"] is None and drift["yoy_drift_rate"] is None


def test_integrity(spark):
    m = model(
        spark,
        [(1, 1, week(0), 1, True), (1, 2, week(0), 1), (9, 1, week(0), 1), (9, 1, week(0), 2)],
        [(1, week(0), [1] * 5)],
    )
    assert rows(m.check_join_integrity()) == [{"sales_rows": 4, "unmatched_rows": 2, "holiday_mismatches": 1}]
    unique = by(m.check_key_uniqueness(), "table_name")
    assert (unique["train"]["rows"], unique["train"]["repeated_keys"]) == (4, 1)
    assert unique["stores"]["repeated_keys"] == 0


def test_empty_inputs_give_empty_or_zero_reports(spark):
    m = model(spark, [], [])
    assert rows(m.check_window_shape())[0]["store_weeks"] == 0
    assert rows(m.check_activity_by_type()) == []
    assert rows(m.scorecard_by_type()) == []
    assert rows(m.store_league()) == []
    assert rows(m.dept_league()) == []
    assert rows(m.marginal_lift()) == []
    assert rows(m.check_key_uniqueness())[0]["rows"] in (0, 3)
