"""SQL expressions shared by all operators, and the two reshaping steps built on them.

Expressions are SQL text: a report has a few hundred, and text reaches the JVM in
one call where composing Column objects takes several per operator.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolift.config import LiftConfig

ROWS = "count(1)"


def as_double(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def ratio(numerator: str, denominator: str) -> str:
    """numerator / denominator as DOUBLE; NULL when the denominator is zero."""
    return f"(CAST({numerator} AS DOUBLE) / nullif(CAST({denominator} AS DOUBLE), 0D))"


def percent(numerator: str, denominator: str) -> str:
    return f"(100D * CAST({numerator} AS DOUBLE) / nullif(CAST({denominator} AS DOUBLE), 0D))"


def rounded(value: str, digits: int) -> str:
    """Decimals are rounded exactly before they are shown as DOUBLE."""
    return f"CAST(round({value}, {digits}) AS DOUBLE)"


def whole(value: str) -> str:
    return rounded(value, 0)


def paid(spend: str) -> str:
    """Recorded spend with missing and negative amounts read as no spend."""
    return f"greatest(coalesce({spend}, 0), 0)"


def flag(condition: str) -> str:
    """1 where the condition holds, else 0 (also when it is unknown)."""
    return f"if({condition}, 1, 0)"


def count_where(condition: str) -> str:
    return f"sum(if({condition}, 1, 0))"


def named(expressions: Mapping[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in expressions.items()]


def aggregate(frame: DataFrame, keys: Iterable[str], sums: Mapping[str, str]) -> DataFrame:
    return frame.groupBy(*keys).agg(*[F.expr(text) for text in named(sums)])


def weeks_between(table: DataFrame, start, end) -> DataFrame:
    """Rows with start <= Date < end.

    Both bounds are plain literals, so they reach the Parquet scan. Tables
    written by ``replace_tables`` are partitioned by year; the same range is put
    on that column to prune directories.
    """
    bounds = []
    if start is not None:
        bounds.append(f"Date >= DATE'{start}'")
    if end is not None:
        bounds.append(f"Date < DATE'{end}'")
    if "year" in table.columns:
        if start is not None:
            bounds.append(f"year >= {start.year}")
        if end is not None:
            bounds.append(f"year <= {end.year}")
    return table.filter(" AND ".join(bounds)) if bounds else table


def per_type(frame: DataFrame, keep: list[str], values: Mapping[str, list[str]], config: LiftConfig) -> DataFrame:
    """Wide to long: one row per promotion type.

    ``values`` maps an output column to its K per-type expressions. NULL values
    are kept, and the input is read once.
    """
    entries = [
        f"struct({number} AS type_no, '{config.label(number)}' AS markdown_type, "
        + ", ".join(named({name: each[number - 1] for name, each in values.items()}))
        + ")"
        for number in config.type_numbers
    ]
    return frame.selectExpr(*keep, f"inline(array({', '.join(entries)}))")


def published(frame: DataFrame, digits: int | None = None) -> DataFrame:
    """Plain output types: integers as BIGINT, money and ratios as DOUBLE.

    ``digits`` additionally rounds the fractional columns, for frames whose
    definition is unrounded.
    """

    def plain(field: T.StructField) -> str:
        if isinstance(field.dataType, T.IntegralType):
            return f"CAST({field.name} AS BIGINT) AS {field.name}"
        if isinstance(field.dataType, (T.DecimalType, T.FractionalType)):
            value = as_double(field.name)
            return f"{value if digits is None else rounded(value, digits)} AS {field.name}"
        return field.name

    return frame.selectExpr(*[plain(field) for field in frame.schema.fields])
