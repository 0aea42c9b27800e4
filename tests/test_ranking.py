from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from promolift.functions import ranking

VALUES = st.one_of(
    st.none(),
    st.sampled_from([0.0, 1.5, -2.0]),
    st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 3)),
)


def _expected(rows):
    """Rank from its definition: one more than the number of rows with a higher value."""
    lowest = float("-inf")
    ranks = []
    for group, value in rows:
        mine = lowest if value is None else value
        ranks.append(1 + sum(g == group and (lowest if v is None else v) > mine for g, v in rows))
    return ranks


def _check(spark, rows, bins):
    frame = spark.createDataFrame(
        [(i, group, value) for i, (group, value) in enumerate(rows)], "id INT, team STRING, score DOUBLE"
    )
    ranked = ranking.rank_league(frame, "score", {"place": (), "team_place": ("team",)}, bins)
    found = sorted((row.id, row.place, row.team_place) for row in ranked.collect())
    everyone = _expected([("", value) for _, value in rows])
    assert found == [(i, everyone[i], place) for i, place in enumerate(_expected(rows))]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(st.sampled_from("AB"), VALUES), min_size=1, max_size=60), bins=st.sampled_from([2, 5, 64])
)
def test_ranks_in_bins_are_exact(spark, rows, bins):
    _check(spark, rows, bins)


def test_a_third_of_the_rows_may_share_a_value(spark):
    _check(spark, [("AB"[n % 2], 7.0 if n % 3 == 0 else float(n % 50)) for n in range(600)], 16)


def test_leagues_are_ranked_as_the_queries_rank_them(spark):
    league = spark.createDataFrame(
        [(1, "A", 3.0), (2, "A", 5.0), (3, "B", 3.0), (4, "B", None)], "id INT, team STRING, score DOUBLE"
    )
    ranked = ranking.rank_league(league, "score", {"place": (), "team_place": ("team",)})
    found = sorted((row.id, row.place, row.team_place) for row in ranked.collect())
    assert found == [(1, 2, 2), (2, 1, 1), (3, 2, 1), (4, 4, 2)]
    assert ranking.rank_league(league.limit(0), "score", {"place": ()}).collect() == []
