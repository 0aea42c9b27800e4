from __future__ import annotations

import dataclasses

from tests.frames import CONFIG, by, model, rows, week, year_before


def _paired(store, dept, number, now, ago, holiday=False):
    return [(store, dept, week(number), now, holiday), (store, dept, year_before(number), ago, holiday)]


def test_lift_is_split_by_spend_share(spark):
    m = model(
        spark,
        _paired(1, 1, 0, 140, 100) + _paired(1, 1, 1, 90, 100) + _paired(1, 1, 2, 500, 100),
        [(1, week(0), [10, 30, 0, 0, 0]), (1, week(1), [0, 20, 0, 0, 0]), (1, week(2), [0] * 5)],
    )
    card = by(m.scorecard_by_type(), "markdown_type")
    assert card["Markdown Type 1"]["attributed_lift"] == 10.0
    assert card["Markdown Type 2"]["attributed_lift"] == 20.0  # 30 of the first week, -10 of the second
    assert card["Markdown Type 1"]["effectiveness_index"] == 2.0
    assert card["Markdown Type 1"]["recommendation"] == "Double down"
    assert card["Markdown Type 2"]["sales_lift_per_dollar"] == 0.4
    assert card["Markdown Type 2"]["recommendation"] == "Reduce"
    assert card["Markdown Type 1"]["pct_of_total_spend"] == 16.7
    # 140 - 100 * 1.0627 split 1 : 3
    assert card["Markdown Type 1"]["net_lift_per_dollar_sensitivity"] == 0.84
    # Never active: lift of zero, no ratio, ranked last.
    third = card["Markdown Type 3"]
    assert (third["attributed_lift"], third["sales_lift_per_dollar"], third["recommendation"]) == (0.0, None, "Cut")
    assert third["effectiveness_rank"] == 3
    parts = rows(m.reconcile_decomposition())[0]
    assert (parts["attributed_lift"], parts["zero_spend_lift"], parts["gap"]) == (30.0, 400.0, 0.0)


def test_index_of_a_negative_pool_is_marked(spark):
    m = model(spark, _paired(1, 1, 0, 60, 100), [(1, week(0), [10, 0, 0, 0, 0])])
    marked = rows(m.scorecard_by_type(with_validity=True))
    assert not any(row["index_valid"] for row in marked)
    assert "index_valid" not in rows(m.scorecard_by_type())[0]


def test_measured_drift_replaces_the_configured_one(spark):
    m = model(
        spark,
        _paired(1, 1, 0, 140, 100) + _paired(1, 1, 1, 120, 100),
        [(1, week(0), [10, 0, 0, 0, 0]), (1, week(1), [0] * 5)],
    )
    card = by(m.scorecard_by_type(drift=m.measured_drift()), "markdown_type")
    assert card["Markdown Type 1"]["net_lift_per_dollar_sensitivity"] == 2.0  # (140 - 100 * 1.2) / 10


def test_holiday_split_uses_the_sales_flag(spark):
    m = model(
        spark,
        _paired(1, 1, 0, 30, 10, True) + _paired(1, 1, 1, 15, 10),
        [(1, week(0), [10, 0, 0, 0, 0], False), (1, week(1), [5, 0, 0, 0, 0], True)],
    )
    card = {(r["markdown_type"], r["week_type"]): r for r in rows(m.scorecard_by_type_holiday())}
    assert card["Markdown Type 1", "Holiday week"]["sales_lift_per_dollar"] == 2.0
    assert card["Markdown Type 1", "Normal week"]["sales_lift_per_dollar"] == 1.0
    # The exported spend fact splits by the spend table's flag instead.
    fact = {r["type_no"]: r for r in rows(m.fact_type_spend)}[1]
    assert (float(fact["total_spend_holiday"]), fact["active_weeks_holiday"]) == (5.0, 1)


def test_store_reports(spark):
    m = model(
        spark,
        _paired(1, 1, 0, 120, 100) + _paired(2, 1, 0, 130, 100) + _paired(7, 1, 0, 500, 1),
        [(1, week(0), [10, 0, 0, 0, 0]), (2, week(0), [0] * 5), (7, week(0), [1] * 5)],
    )
    league = by(m.store_league(), "store")
    assert set(league) == {1, 2}  # store 7 is not in the dimension
    assert (league[1]["store_rank"], league[1]["sales_lift_per_dollar"], league[1]["yoy_growth_pct"]) == (1, 2.0, 20.0)
    assert (league[2]["store_rank"], league[2]["sales_lift_per_dollar"]) == (2, None)
    grid = rows(m.type_by_store())
    assert [(r["store"], r["markdown_type"]) for r in grid] == [(1, "Markdown Type 1")]
    formats = rows(m.type_by_format())
    assert len(formats) == 10
    assert {r["rank_within_format"] for r in formats if r["store_format"] == "B"} == {1}


def test_department_reports(spark):
    config = dataclasses.replace(CONFIG, min_stores=2, min_baseline=100, cut_min_spend=2, top_departments=1)
    m = model(
        spark,
        _paired(1, 1, 0, 90, 75) + _paired(1, 2, 0, 20, 25) + _paired(2, 1, 0, 50, 40) + _paired(1, 3, 0, 9, -5),
        [(1, week(0), [8, 0, 0, 0, 4]), (2, week(0), [4, 0, 0, 0, 0])],
        config=config,
    )
    league = by(m.dept_league(), "dept")
    assert set(league) == {1, 2}  # nothing is allocated to a negative baseline
    assert (league[1]["stores"], league[1]["allocated_md_spend"]) == (2, 13.0)
    assert (league[1]["materiality"], league[1]["dept_rank"], league[1]["rank_among_material"]) == ("Material", 1, 1)
    assert league[2]["materiality"] == "Low base - treat with caution"
    assert (league[2]["dept_rank"], league[2]["rank_among_material"]) == (2, 1)
    assert [(r["dept"], r["allocated_md_spend"]) for r in rows(m.dept_cut_list())] == [(2, 3.0)]
    top = {(r["dept"], r["markdown_type"]): r for r in rows(m.dept_by_type_top())}
    assert set(top) == {(1, "Markdown Type 1"), (1, "Markdown Type 5")}
    assert top[1, "Markdown Type 1"]["allocated_spend"] == 10.0  # 8 * 0.75 + 4
    assert top[1, "Markdown Type 1"]["attributed_lift"] == 20.0  # 15 * 8/12 + 10
    lift = rows(m.reconcile_lift())[0]
    assert lift["gap"] == 0.0 and lift["export_gap"] == -14.0


def test_marginal_contrast(spark):
    heavy, light = [30, 0, 0, 0, 0], [10, 0, 0, 0, 0]
    m = model(
        spark,
        _paired(1, 1, 0, 110, 100) + _paired(1, 1, 1, 500, 100) + _paired(1, 1, 2, 150, 100),
        [(1, week(0), light), (1, week(1), [20, 0, 0, 0, 0]), (1, week(2), heavy)],
    )
    first = by(m.marginal_lift(), "markdown_type")["Markdown Type 1"]
    assert (first["stores_measured"], first["incremental_spend"], first["incremental_sales"]) == (1, 20.0, 40.0)
    assert (first["marginal_lift_per_dollar"], first["avg_growth_gap_pp"], first["stores_positive"]) == (2.0, 40.0, 1)


def test_marginal_contrast_needs_both_tiles_and_positive_baselines(spark):
    m = model(
        spark,
        _paired(1, 1, 0, 5, 4) + _paired(1, 1, 1, 6, 4)  # two weeks: no third tile
        + _paired(2, 1, 0, 5, -4) + _paired(2, 1, 1, 5, 4) + _paired(2, 1, 2, 5, 4),
        [(s, week(n), [n + 1, 0, 0, 0, 0]) for s in (1, 2) for n in range(3)],
    )
    # Type 1 orders store 2's weeks by spend, so its negative baseline is the light tile.
    assert "Markdown Type 1" not in by(m.marginal_lift(), "markdown_type")


def test_equal_spends_are_cut_by_week(spark):
    m = model(
        spark,
        _paired(1, 1, 0, 110, 100) + _paired(1, 1, 1, 100, 100) + _paired(1, 1, 2, 130, 100),
        [(1, week(n), [5, 0, 0, 0, 0]) for n in range(3)],
    )
    first = by(m.marginal_lift(), "markdown_type")["Markdown Type 1"]
    assert (first["incremental_spend"], first["incremental_sales"]) == (0.0, 20.0)
    assert first["marginal_lift_per_dollar"] is None


def test_tiles_are_cut_again_without_holidays(spark):
    m = model(
        spark,
        [row for n, now in enumerate((110, 120, 130, 900)) for row in _paired(1, 1, n, now, 100)],
        [(1, week(n), [n + 1, 0, 0, 0, 0], n == 3) for n in range(4)],
    )
    first = by(m.marginal_lift_ex_holiday(), "markdown_type")["Markdown Type 1"]
    assert (first["incremental_spend"], first["incremental_sales"]) == (2.0, 20.0)
    both = by(m.method_comparison(), "markdown_type")["Markdown Type 1"]
    assert both["marginal_lift_per_dollar_ex_holiday"] == 10.0


def test_confound_counts_other_heavy_types(spark):
    spends = [[1, 1, 0, 0, 0], [2, 2, 0, 0, 0], [3, 3, 0, 0, 0]]
    m = model(spark, [], [(1, week(n), spend) for n, spend in enumerate(spends)])
    found = by(m.intensity_confound(), "markdown_type")
    # Unspent types tie in every week; the last week is their heaviest too.
    assert found["Markdown Type 1"]["top_tertile_store_weeks"] == 1
    assert found["Markdown Type 1"]["avg_other_types_also_high"] == 4.0
    assert found["Markdown Type 1"]["pct_weeks_this_type_alone_high"] == 0.0


def test_measures_follow_filters(spark):
    m = model(
        spark,
        _paired(1, 1, 0, 140, 100) + _paired(2, 1, 0, 110, 100),
        [(1, week(0), [10, 30, 0, 0, 0]), (2, week(0), [20, 0, 0, 0, 0])],
    )
    # One ratio of sums, not an average of ratios: 50 / 60.
    overall = rows(m.measure_type(dims=[]))[0]
    assert round(overall["sales_lift_per_dollar"], 4) == 0.8333
    only_a = rows(m.measure_type(filters={"store_format": ["A"], "markdown_type": ["Markdown Type 1"]}))
    assert [(float(r["total_spend"]), r["attributed_lift"]) for r in only_a] == [(10.0, 10.0)]
    # A filter on the type moves the index's numerator but not what it is compared with.
    index = rows(m.measure_index(dims=["markdown_type"], filters={"markdown_type": ["Markdown Type 2"]}))
    assert [round(r["effectiveness_index"], 4) for r in index] == [round((30 / 30) / (50 / 60), 4)]
    total = rows(m.measure_index(dims=[], filters={"markdown_type": ["Markdown Type 1"]}))
    assert round(total[0]["effectiveness_index"], 4) == round((20 / 30) / (50 / 60), 4)
    # Other filters hold on both sides.
    in_a = rows(m.measure_index(dims=["markdown_type"], filters={"store_format": ["A"]}))
    assert {r["effectiveness_index"] for r in in_a if r["effectiveness_index"] is not None} == {1.0}
    growth = rows(m.measure_yoy(dims=["store_format"]))
    assert {r["store_format"]: r["yoy_growth"] for r in growth} == {"A": 0.4, "B": 0.1}
    banded = rows(m.measure_format_type(filters={"size_band": ["Large"]}))
    assert {r["store_format"] for r in banded} == {"A"}


def test_size_bands(spark):
    shops = [(1, "A", 150000), (2, "A", 149999), (3, "B", 70000), (4, "C", 69999), (5, "C", None)]
    m = model(spark, [], [], shops)
    assert [r["size_band"] for r in rows(m.dim_store.orderBy("store"))] == ["Large", "Medium", "Medium", "Small", "Small"]


def test_views_answer_plain_sql(spark):
    m = model(spark, _paired(1, 1, 0, 140, 100), [(1, week(0), [10, 30, 0, 0, 0])])
    m.create_views()
    found = spark.sql(
        """SELECT m.markdown_type, SUM(l.lift_dollars * m.spend_share) AS lift
           FROM v_markdown_long m JOIN v_store_week_lift l USING (store, week) GROUP BY ALL"""
    )
    assert by(found, "markdown_type")["Markdown Type 2"]["lift"] == 30.0
    assert spark.table("v_dept_week_lift").count() == 1
    assert spark.table("train").count() == 2
