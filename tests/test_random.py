"""All reports on random tables with gaps, NULLs, negatives and flags that disagree."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal
from random import Random

import duckdb
import pytest

from check_oracles import compare
from oracles.statements import STATEMENTS, with_frames
from promolift import LiftModel, Tables
from promolift.plans.registry import FRAMES, REPORTS, report
from promolift.sources.testdata import CONFIG

FIRST = date(1998, 12, 7)
GIVEN = frozenset({"sales", "spending", "shops"})


def _amount(random: Random, low: float, high: float, holes: float):
    if random.random() < holes:
        return None
    return Decimal(random.randint(int(low * 100), int(high * 100))) / 100


def _tables(seed: int):
    random = Random(seed)
    weeks = [FIRST + timedelta(weeks=n) for n in range(112)]
    sales, spending, shops = [], [], []
    for store in range(24):
        band = ("Small", 30000) if store % 3 == 0 else ("Medium", 90000) if store % 3 == 1 else ("Large", 180000)
        if store != 23:  # one store is missing from the dimension
            shops.append((store, "ABC"[store % 3 if store < 12 else store % 2], band[1], band[0]))
        for week in weeks:
            flag = int(week.day <= 7 and week.month % 3 == 0)
            if random.random() > 0.05:
                quiet = random.random() < 0.1
                spends = [None if quiet else _amount(random, -20, 900, 0.3) for _ in range(5)]
                spending.append((store, week, flag, *spends))
            for dept in ("BAKERY", "DAIRY", "FRUIT", "TOYS"):
                if random.random() > 0.15:
                    other_flag = 1 - flag if random.random() < 0.01 else flag
                    high = 90000 if dept == "DAIRY" else 30000
                    sales.append((store, dept, week, other_flag, _amount(random, -2000, high, 0.01)))
    return sales, spending, shops


@pytest.fixture(scope="module", params=[1])
def both(request, spark):
    sales, spending, shops = _tables(request.param)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE sales (store INT, dept VARCHAR, week DATE, h INT, amount DECIMAL(18,2))")
    spends = ", ".join(f"m{k} DECIMAL(18,2)" for k in range(1, 6))
    duck.execute(f"CREATE TABLE spending (store INT, week DATE, h INT, {spends})")
    duck.execute("CREATE TABLE shops (store INT, fmt VARCHAR, size INT, band VARCHAR)")
    tables = {"sales": sales, "spending": spending, "shops": shops}
    schemas = {
        "sales": "Store INT, Dept STRING, Date DATE, IsHoliday INT, Weekly_Sales DECIMAL(18,2)",
        "spending": "Store INT, Date DATE, IsHoliday INT, "
        + ", ".join(f"{name} DECIMAL(18,2)" for name in CONFIG.spend_columns),
        "shops": "Store INT, Type STRING, Size INT, Band STRING",
    }
    frames = {}
    for name, rows in tables.items():
        frames[name] = spark.createDataFrame(rows, schemas[name]).repartition(5)
        view = frames[name].toPandas()
        duck.register("incoming", view)
        duck.execute(f"INSERT INTO {name} SELECT * FROM incoming")
        duck.unregister("incoming")
    model = LiftModel(Tables(frames["sales"], frames["spending"], frames["shops"].drop("Band")), CONFIG)
    return model, duck


@pytest.mark.parametrize("name", [*FRAMES, *REPORTS])
def test_report_equals_sql(both, name):
    model, duck = both
    assert compare(report(model, name), duck.sql(with_frames(STATEMENTS[name], GIVEN))) is None
