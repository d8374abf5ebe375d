"""Closed-form trailing-value baselines (F11 margin, F12 revenue) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trailing(value: str, recent: str, previous: str, smoothing: float, clip: float) -> Column:
    a, b = F.col(recent), F.col(previous)
    change = (a - b) / (F.abs(a) + F.abs(b) + F.lit(float(smoothing)))
    change = F.least(F.greatest(change, F.lit(-float(clip))), F.lit(float(clip)))
    weight = F.exp(-F.col("recency_days").cast("double") / F.lit(220.0))
    return F.col(value) * weight * (F.lit(1.0) + change)


def margin_baseline() -> Column:
    """margin_180d * exp(-recency/220) * (1 + clip((m90 - prev90)/(|m90|+|prev90|+10), ±0.45))."""
    return _trailing("margin_180d", "margin_90d", "margin_previous_90d", 10.0, 0.45)


def revenue_baseline() -> Column:
    """net_revenue_180d * exp(-recency/220) * (1 + clip((r90 - prev90)/(|r90|+|prev90|+1), ±0.5))."""
    return _trailing("net_revenue_180d", "net_revenue_90d", "net_revenue_previous_90d", 1.0, 0.5)
