"""For each query, one DuckDB statement over the raw tables that gives the same rows.

The statements follow the definitions in long form: one row per type from the
start, windows where the library joins sums, two tiles joined where it sums
conditionally. They share no code with it.
"""

from __future__ import annotations

from oracles.statements import STATEMENTS, with_frames


def all_oracles() -> dict[str, str]:
    return {name: with_frames(body) for name, body in STATEMENTS.items()}
