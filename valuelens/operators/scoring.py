"""Closed-form scored frames (no fitted model): a two-part style score
P(active) x value with a raw interval, used to drive conformal, evaluation,
deciles, policy, bootstrap and importance operators with reproducible inputs.

  activity probability  orders_365d / (orders_365d + 1)
  prediction            round(P(active) * 0.5 * trailing-year value, 6)
  raw interval          envelope of (0.4*pred - 1, 1.6*pred + 1)  (7th digit even: no rounding ties)
  baseline              round(F11 / F12 baseline, 6)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from .baseline import margin_baseline, revenue_baseline
from .conformal import interval_envelope

MARGIN_NAMES = {
    "actual": "future_discounted_margin_180d", "active": "future_active_180d",
    "pred": "predicted_clv_180d", "prob": "active_probability_180d",
    "lower_raw": "clv_lower_80_raw", "upper_raw": "clv_upper_80_raw",
    "lower": "clv_lower_80", "upper": "clv_upper_80", "baseline": "baseline_clv_180d",
    "trailing": "margin_365d",
}
REVENUE_NAMES = {
    "actual": "future_net_revenue_180d", "active": "future_active_180d",
    "pred": "predicted_revenue_180d", "prob": "active_probability_180d",
    "lower_raw": "revenue_lower_80_raw", "upper_raw": "revenue_upper_80_raw",
    "lower": "revenue_lower_80", "upper": "revenue_upper_80", "baseline": "baseline_revenue_180d",
    "trailing": "net_revenue_365d",
}


def closed_form_scores(snapshots: DataFrame, path: str = "margin") -> DataFrame:
    names = MARGIN_NAMES if path == "margin" else REVENUE_NAMES
    base = margin_baseline() if path == "margin" else revenue_baseline()
    prob = F.col("orders_365d").cast("double") / (F.col("orders_365d").cast("double") + F.lit(1.0))
    scored = snapshots.select(
        "customer_id", "snapshot_date", *[c for c in snapshots.columns if c not in ("customer_id", "snapshot_date")],
        r6(base).alias(names["baseline"]),
        prob.alias(names["prob"]),
    ).withColumn(names["pred"], r6(F.col(names["prob"]) * F.lit(0.5) * F.col(names["trailing"])))
    p = F.col(names["pred"])
    lo, hi = interval_envelope(p, F.lit(0.4) * p - F.lit(1.0), F.lit(1.6) * p + F.lit(1.0))
    return scored.withColumn(names["lower_raw"], lo).withColumn(names["upper_raw"], hi)
