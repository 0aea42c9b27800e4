"""Small hand-written inputs with the default column names and types."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from promolift import LiftConfig, LiftModel, Tables
from promolift.sources import schemas

START = date(2011, 11, 4)
CONFIG = LiftConfig(window_start=START, window_end=START + timedelta(weeks=52))


def money(value):
    return None if value is None else Decimal(str(value))


def week(number: int) -> date:
    return START + timedelta(weeks=number)


def year_before(number: int) -> date:
    return week(number) - timedelta(days=364)


def train(spark, rows):
    """(store, dept, date, sales[, holiday])"""
    full = [(s, d, day, money(amount), bool(rest[0]) if rest else False) for s, d, day, amount, *rest in rows]
    return spark.createDataFrame(full, schemas.sales_schema())


def features(spark, rows, config=CONFIG):
    """(store, date, [spend per type][, holiday])"""
    full = [
        (s, day, 1.0, 1.0, *[money(x) for x in spends], 1.0, 1.0, bool(rest[0]) if rest else False)
        for s, day, spends, *rest in rows
    ]
    return spark.createDataFrame(full, schemas.features_schema(config))


def stores(spark, rows=((1, "A", 200000), (2, "B", 100000), (3, "C", 40000))):
    return spark.createDataFrame(list(rows), schemas.STORES)


def model(spark, train_rows, feature_rows, store_rows=None, config=CONFIG) -> LiftModel:
    shops = stores(spark) if store_rows is None else stores(spark, store_rows)
    return LiftModel(Tables(train(spark, train_rows), features(spark, feature_rows, config), shops), config)


def rows(frame) -> list[dict]:
    return [row.asDict() for row in frame.collect()]


def by(frame, key: str) -> dict:
    return {row[key]: row.asDict() for row in frame.collect()}
