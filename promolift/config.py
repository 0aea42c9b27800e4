"""Everything an analyst may want to change, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class LiftConfig:
    # Half-open measurement window [window_start, window_end).
    window_start: date = date(2011, 11, 1)
    window_end: date = date(2012, 10, 27)
    # 52 whole weeks, so a week is compared with the same weekday a year before.
    offset_days: int = 364

    # One spend column per promotion type, in type order. Their number is free.
    spend_columns: tuple[str, ...] = ("MarkDown1", "MarkDown2", "MarkDown3", "MarkDown4", "MarkDown5")
    type_label: str = "Markdown Type {}"

    # Year-on-year drift charged in the stress test of the scorecard.
    drift_rate: float = 0.0627

    # Index thresholds of the recommendation.
    double_down_at: float = 1.15
    hold_at: float = 0.85

    # Department materiality, cut list and top list.
    min_stores: int = 30
    min_baseline: int = 5_000_000
    cut_min_spend: int = 100_000
    top_departments: int = 10

    # Spend intensity: number of tiles a store's weeks are cut into.
    tiles: int = 3

    # Lower bounds of the size bands, largest first; smaller stores are "Small".
    size_bands: tuple[tuple[int, str], ...] = ((150_000, "Large"), (70_000, "Medium"))
    smallest_band: str = "Small"

    @property
    def type_numbers(self) -> range:
        return range(1, len(self.spend_columns) + 1)

    @property
    def baseline_start(self) -> date:
        return self.window_start - timedelta(days=self.offset_days)

    @property
    def baseline_end(self) -> date:
        return self.window_end - timedelta(days=self.offset_days)

    def label(self, type_no: int) -> str:
        return self.type_label.format(type_no)
