"""Published results for the full retail data set, from its sums per type.

Fixed values: spend, active weeks and attributed lift per type, and the table
reported for them.
"""

from __future__ import annotations

from tests.frames import CONFIG, by

from promolift.operators.measures import index_measure, type_measures
from promolift.operators.scorecard import score_types

SUMS = [
    (1, 15630739.34, 2280, 20880485.1774),
    (2, 5270018.03, 1615, 9046166.1191),
    (3, 2761830.45, 2041, -498324.8975),
    (4, 6492081.25, 1965, 7172322.1449),
    (5, 10178926.84, 2295, 16336350.1161),
]

# type: % of spend, lift per dollar, index, rank, recommendation
REPORTED = {
    "Markdown Type 1": (38.8, 1.34, 1.02, 3, "Hold"),
    "Markdown Type 2": (13.1, 1.72, 1.31, 1, "Double down"),
    "Markdown Type 3": (6.8, -0.18, -0.14, 5, "Cut"),
    "Markdown Type 4": (16.1, 1.10, 0.84, 4, "Reduce"),
    "Markdown Type 5": (25.2, 1.60, 1.22, 2, "Double down"),
}


def _sums(spark):
    rows = [(k, CONFIG.label(k), spend, weeks, lift, None) for k, spend, weeks, lift in SUMS]
    return spark.createDataFrame(
        rows,
        "type_no INT, markdown_type STRING, spend DOUBLE, active BIGINT, lift DOUBLE, net_lift DOUBLE",
    )


def test_scorecard(spark):
    found = by(score_types(_sums(spark), CONFIG), "markdown_type")
    seen = {
        name: (
            row["pct_of_total_spend"],
            row["sales_lift_per_dollar"],
            row["effectiveness_index"],
            row["effectiveness_rank"],
            row["recommendation"],
        )
        for name, row in found.items()
    }
    assert seen == REPORTED


def test_totals(spark):
    assert round(sum(spend for _, spend, _, _ in SUMS), 2) == 40333595.91
    assert round(sum(lift for _, _, _, lift in SUMS), 2) == 52936998.66


def test_measures_agree_with_the_scorecard(spark):
    fact = _sums(spark).selectExpr("markdown_type", "spend AS total_spend", "lift AS attributed_lift")
    ratios = by(type_measures(fact, ["markdown_type"]), "markdown_type")
    index = by(index_measure(fact, ["markdown_type"]), "markdown_type")
    for name, (_, per_dollar, idx, _, _) in REPORTED.items():
        assert round(ratios[name]["sales_lift_per_dollar"], 2) == per_dollar
        assert round(index[name]["effectiveness_index"], 2) == idx
