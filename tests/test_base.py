from __future__ import annotations

import dataclasses

import pytest

from tests.frames import CONFIG, by, features, model, rows, train, week, year_before

from promolift.operators import base


def test_missing_zero_and_negative_spend_are_no_spend(spark):
    frame = base.spend_store_week(
        features(spark, [(1, week(0), [None, 0, -5, 7.25, 2.75]), (2, week(0), [None] * 5)]), CONFIG
    )
    first = by(frame, "store")[1]
    assert [float(first[f"md{k}"]) for k in range(1, 6)] == [0, 0, 0, 7.25, 2.75]
    assert float(first["total_md_spend"]) == 10.0
    assert first["types_active"] == 2
    assert by(frame, "store")[2]["types_active"] == 0


def test_window_is_half_open(spark):
    frame = base.spend_store_week(
        features(spark, [(1, week(-1), [1] * 5), (1, week(0), [1] * 5), (1, week(51), [1] * 5), (1, week(52), [1] * 5)]),
        CONFIG,
    )
    assert sorted(row["week"] for row in rows(frame)) == [week(0), week(51)]


def test_long_keeps_every_type_and_leaves_share_null_without_spend(spark):
    spend = base.spend_store_week(features(spark, [(1, week(0), [4, 0, 0, 0, 12]), (2, week(0), [0] * 5)]), CONFIG)
    long = rows(base.spend_long(spend, CONFIG))
    assert len(long) == 10
    first = {row["type_no"]: row for row in long if row["store"] == 1}
    assert [first[k]["spend_share"] for k in range(1, 6)] == [0.25, 0, 0, 0, 0.75]
    assert [first[k]["is_active"] for k in range(1, 6)] == [1, 0, 0, 0, 1]
    assert first[5]["markdown_type"] == "Markdown Type 5"
    assert all(row["spend_share"] is None for row in long if row["store"] == 2)


def test_pairs_use_364_days_and_drop_the_unmatched(spark):
    pair = base.yoy_pair(
        train(
            spark,
            [
                (1, 1, week(0), 110),
                (1, 1, year_before(0), 100),
                (1, 1, week(1), 50),  # no baseline week
                (1, 2, week(0), 70),  # department new this year
                (1, 3, year_before(0), 30),  # department gone
                (2, 1, week(3), 10),
                (2, 1, year_before(2), 99),  # a missing week must not shift its neighbour
            ],
        ),
        CONFIG,
    )
    assert [(r["store"], r["dept"], r["week"], float(r["lift_dollars"])) for r in rows(pair)] == [
        (1, 1, week(0), 10.0)
    ]


def test_repeated_keys_multiply_pairs(spark):
    pair = base.yoy_pair(
        train(spark, [(1, 1, week(0), 5), (1, 1, week(0), 6), (1, 1, year_before(0), 1), (1, 1, year_before(0), 2)]),
        CONFIG,
    )
    assert pair.count() == 4


def test_store_week_splits_when_departments_disagree_on_the_flag(spark):
    m = model(
        spark,
        [
            (1, 1, week(0), 10, True),
            (1, 1, year_before(0), 4),
            (1, 2, week(0), 20, False),
            (1, 2, year_before(0), 5),
        ],
        [(1, week(0), [3, 0, 0, 0, 0])],
    )
    assert m.lift_store_week.count() == 2
    # Spend then counts once per flag, as a join on store and week does.
    assert rows(m.scorecard_by_type())[0]["total_spend"] == 6.0
    assert rows(m.check_holiday_consistency()) == [{"store_weeks": 1, "disagreeing_store_weeks": 1}]


def test_department_share_counts_positive_baselines_only(spark):
    pair = base.yoy_pair(
        train(
            spark,
            [(1, d, week(0), 1) for d in range(1, 6)]
            + [(1, 1, year_before(0), 30), (1, 2, year_before(0), 10), (1, 3, year_before(0), -7)]
            + [(1, 4, year_before(0), 0), (1, 5, year_before(0), None)],
        ),
        CONFIG,
    )
    shares = {dept: row["dept_baseline_share"] for dept, row in by(base.lift_dept_week(pair), "dept").items()}
    assert shares == {1: 0.75, 2: 0.25, 3: 0.0, 4: 0.0, 5: 0.0}


def test_all_shares_zero_without_a_positive_baseline(spark):
    pair = base.yoy_pair(train(spark, [(1, 1, week(0), 9), (1, 1, year_before(0), -2)]), CONFIG)
    assert rows(base.lift_dept_week(pair))[0]["dept_baseline_share"] == 0.0


def test_number_of_types_comes_from_the_configuration(spark):
    two = dataclasses.replace(CONFIG, spend_columns=("Flyer", "Coupon"), type_label="Promotion {}")
    m = model(
        spark,
        [(1, 1, week(0), 12), (1, 1, year_before(0), 10)],
        [(1, week(0), [3, 1])],
        config=two,
    )
    found = by(m.scorecard_by_type(), "markdown_type")
    assert set(found) == {"Promotion 1", "Promotion 2"}
    assert found["Promotion 1"]["attributed_lift"] == 2.0 and found["Promotion 2"]["total_spend"] == 1.0


@pytest.mark.parametrize("holiday_type", ["boolean", "int"])
def test_flags_may_be_boolean_or_number(spark, holiday_type):
    table = train(spark, [(1, 1, week(0), 2, True), (1, 1, year_before(0), 1)])
    table = table.withColumn("IsHoliday", table.IsHoliday.cast(holiday_type))
    assert rows(base.yoy_pair(table, CONFIG))[0]["is_holiday"] == 1
