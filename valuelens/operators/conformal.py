"""Prediction-interval envelope (F6), split-conformal correction (F9) and its
application (F10)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import find_cuts


def interval_envelope(point: Column, lower: Column, upper: Column) -> tuple[Column, Column]:
    """Raw interval that always contains the point: (min(lower, p), max(upper, p))."""
    return F.least(lower, point), F.greatest(upper, point)


def apply_correction(point: Column, raw_lower: Column, raw_upper: Column,
                     correction: Column | float) -> tuple[Column, Column]:
    c = correction if isinstance(correction, Column) else F.lit(float(correction))
    return F.least(raw_lower - c, point), F.greatest(raw_upper + c, point)


def conformal_correction(calibration: DataFrame, actual: str, raw_lower: str, raw_upper: str,
                         key_cols: list[str], target_coverage: float = 0.80) -> DataFrame:
    """One-row frame: target_coverage, correction, calibration_rows, raw_coverage,
    calibrated_coverage.

    Conformity score s = max(lower - y, y - upper).  With n rows and
    k = ceil((n+1)*t), the correction is the (k+1)-th smallest score (the largest
    when k >= n), floored at 0: NumPy's ``quantile(s, min(1, k/n), 'higher')``.
    The order statistic is found by distributed selection; the correction of no rows is null.
    """
    t = float(target_coverage)
    if not 0.0 < t < 1.0 or math.isnan(t):
        raise ValueError("target_coverage must lie inside (0, 1)")
    y, lo, hi = F.col(actual), F.col(raw_lower), F.col(raw_upper)
    scored = calibration.select(*key_cols, y.alias("_y"), lo.alias("_lo"), hi.alias("_hi"),
                                F.greatest(lo - y, y - hi).alias("_s"))
    cuts = find_cuts(scored, "_s", key_cols, lambda n: [min(math.ceil((n + 1) * t) + 1, n)])
    at = cuts.scores()[0] if cuts.rows else None
    correction = F.lit(None if at is None else max(at, 0.0)).cast("double")
    cov_raw = ((F.col("_y") >= F.col("_lo")) & (F.col("_y") <= F.col("_hi"))).cast("double")
    cov_cal = ((F.col("_y") >= F.col("_lo") - correction)
               & (F.col("_y") <= F.col("_hi") + correction)).cast("double")
    out = scored.agg(
        F.first(correction).alias("correction"),
        F.count(F.lit(1)).alias("calibration_rows"),
        F.avg(cov_raw).alias("raw_coverage"),
        F.avg(cov_cal).alias("calibrated_coverage"),
    )
    return out.select(F.lit(t).alias("target_coverage"), "correction",
                      F.col("calibration_rows").cast("bigint").alias("calibration_rows"),
                      "raw_coverage", "calibrated_coverage")
