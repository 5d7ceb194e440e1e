"""Business thresholds; every operator takes a ``Policy`` instead of literals."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    target_days: int = 5          # reorder up to this many days of demand
    red_days: float = 2.0         # below: red
    orange_days: float = 5.0      # up to: orange, and at risk
    overstock_days: int = 30      # above: potential waste
    window_rows: int = 7          # rolling usage, in rows
    history_rows: int = 14        # rows used by the forecast trend
    horizon_days: int = 7         # how far the trend is carried forward
    alert_days: float = 2.0       # alert at or below
    cooldown_hours: int = 1       # one alert per pair in this span
    recent_hours: int = 24        # "recent actions" span
    hot_rows: int = 1_000_000     # a window group above this is split


DEFAULT_POLICY = Policy()
