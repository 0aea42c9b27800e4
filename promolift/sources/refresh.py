"""Stored pairs that follow a changing sales table week by week.

Every week of the sales table has a fingerprint. A week whose fingerprint has
changed makes the pairs of that week stale, where it is the window side, and
those of the week one offset later, where it is the baseline. Only stale weeks
are paired again and written; the others stay where earlier refreshes left them.
Readers are switched once, so they find either the old or the new state whole.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from promolift.config import LiftConfig
from promolift.functions.columns import ROWS, aggregate, weeks_between
from promolift.operators.base import lift_dept_week, lift_store_week, yoy_pair
from promolift.sources.versions import Versions

FRAMES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "yoy_pair": lambda pair: pair,
    "lift_store_week": lift_store_week,
    "lift_dept_week": lift_dept_week,
}

REPORT = "week DATE, action STRING, pairs BIGINT"


def fingerprints(train: DataFrame, config: LiftConfig) -> dict[date, str]:
    """Row count and order-free digests of each week that takes part in a pair.

    One row per week, however large the table. Two digests of every row are added
    up, so that repeated rows do not cancel each other.
    """
    columns = sorted(name for name in train.columns if name != "year")
    takes_part = reduce(
        DataFrame.unionAll,
        [
            weeks_between(train, start, end).select(*columns)
            for start, end in _ranges(config)
        ],
    )
    digest = ", ".join(f"CAST({name} AS STRING)" for name in columns)
    sums = {
        "rows": ROWS,
        "one": f"sum(CAST(xxhash64({digest}) AS DECIMAL(20,0)))",
        "two": f"sum(CAST(xxhash64('again', {digest}) AS DECIMAL(20,0)))",
    }
    return {row.Date: f"{row.rows} {row.one} {row.two}" for row in aggregate(takes_part, ["Date"], sums).collect()}


def _ranges(config: LiftConfig) -> list[tuple[date, date]]:
    """The dates of window and baseline, as ranges that do not overlap."""
    first, second = (config.baseline_start, config.baseline_end), (config.window_start, config.window_end)
    return [(first[0], second[1])] if first[1] >= second[0] else [first, second]


class WeeklyPairs:
    """Pairs, their store-week sums and their department shares, stored by week under one folder."""

    def __init__(self, spark: SparkSession, folder: str, config: LiftConfig = LiftConfig()):
        self.spark = spark
        self.config = config
        self.versions = Versions(spark, folder)

    def _offset(self, week: date, sign: int = 1) -> date:
        return week + sign * timedelta(days=self.config.offset_days)

    def _in_window(self, week: date) -> bool:
        return self.config.window_start <= week < self.config.window_end

    def _stored(self) -> dict:
        settings = repr((self.config.window_start, self.config.window_end, self.config.offset_days))
        found = self.versions.current()
        if found is None or found["totals"]["settings"] != settings:
            return {"tables": {}, "totals": {"settings": settings, "weeks": {}, "pairs": {}}}
        return found

    def refresh(self, train: DataFrame) -> DataFrame:
        """Bring the stored frames up to date: week, action (built, kept or removed) and pairs, per week of the window."""
        stored = self._stored()
        known, now = stored["totals"]["weeks"], {str(week): text for week, text in fingerprints(train, self.config).items()}
        changed = [date.fromisoformat(week) for week in known.keys() | now.keys() if known.get(week) != now.get(week)]
        stale = {week for day in changed for week in (day, self._offset(day)) if self._in_window(week)}
        paired = {str(w) for w in stale if str(w) in now and str(self._offset(w, -1)) in now}
        path = self.versions.begin()
        tables = {week: folder for week, folder in stored["tables"].items() if date.fromisoformat(week) not in stale}
        pairs = {week: stored["totals"]["pairs"][week] for week in tables}
        if paired:
            pairs |= self._write(train, sorted(paired), path)
            tables |= {week: path for week in paired}
        if changed:
            totals = {"settings": stored["totals"]["settings"], "weeks": now, "pairs": pairs}
            self.versions.commit(path, tables, totals, set(tables.values()))
        report = [
            (date.fromisoformat(week), "built" if week in paired else "kept", pairs[week]) for week in sorted(tables)
        ]
        report += [(week, "removed", 0) for week in sorted(stale) if str(week) in stored["tables"] and str(week) not in tables]
        return self.spark.createDataFrame(report, REPORT)

    def _write(self, train: DataFrame, weeks: list[str], path: str) -> dict[str, int]:
        """Pair the weeks and write their frames, a folder a week; the number of pairs of each."""
        days = ", ".join(f"DATE'{week}', DATE'{self._offset(date.fromisoformat(week), -1)}'" for week in weeks)
        of_window = ", ".join(f"DATE'{week}'" for week in weeks)
        # A day may be in the list as the baseline of one week and lie in the window of another that is not stale.
        fresh = yoy_pair(train.where(f"Date IN ({days})"), self.config).where(f"week IN ({of_window})")
        by_week = lambda frame: frame.withColumn("of_week", F.col("week")).hint("rebalance", F.col("of_week"))
        by_week(fresh).write.partitionBy("of_week").parquet(f"{path}/yoy_pair")
        pair = self._read("yoy_pair", fresh.schema, {week: path for week in weeks})
        for name in ("lift_store_week", "lift_dept_week"):
            by_week(FRAMES[name](pair)).write.partitionBy("of_week").parquet(f"{path}/{name}")
        counted = {str(row.week): row.pairs for row in aggregate(pair, ["week"], {"pairs": ROWS}).collect()}
        return {week: counted.get(week, 0) for week in weeks}

    def _read(self, name: str, schema: StructType, folders: dict[str, str]) -> DataFrame:
        reader = self.spark.read.schema(schema)
        paths = [f"{folder}/{name}/of_week={week}" for week, folder in sorted(folders.items())]
        paths = [path for path in paths if self.versions.exists(path)]  # a week may have no pairs at all
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def frames(self, train: DataFrame) -> dict[str, DataFrame]:
        """The stored frames by name. ``train`` gives the types of their columns and is not read."""
        pair = yoy_pair(train, self.config)
        folders = self._stored()["tables"]
        return {name: self._read(name, frame(pair).schema, folders) for name, frame in FRAMES.items()}
