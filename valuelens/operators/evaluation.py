"""Evaluation operators (G1-G18): error, ranking, value capture, interval coverage,
activity scores, deciles, group diagnostics and capture curves.

Every metric is a distributed aggregate; the ones that need a global order
(Spearman, average precision) use ``ranking.global_rank`` / ``global_prefix_sum`` instead
of an un-partitioned window; those that need its cut points only (top-fraction capture,
deciles, capture curve) use ``selection.find_cuts`` and move no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import average_rank, global_prefix_sum
from .selection import find_cuts


def wape_expr(actual: Column, pred: Column) -> Column:
    """Σ|y - p| / Σ|y|, 0 when Σ|y| = 0 (aggregate expression)."""
    return F.coalesce(F.try_divide(F.sum(F.abs(actual - pred)), F.sum(F.abs(actual))), F.lit(0.0))


def error_metrics(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """One row: mae, wape, rmse."""
    y, p = F.col(actual), F.col(pred)
    return df.agg(
        F.avg(F.abs(y - p)).alias("mae"),
        wape_expr(y, p).alias("wape"),
        F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse"),
    )


def pearson_expr(x: Column, y: Column) -> Column:
    """Pearson correlation, 0 when either side is constant (no ANSI divide error)."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def spearman(df: DataFrame, actual: str, pred: str, key_cols: Sequence[str]) -> DataFrame:
    """One row: spearman = Pearson of tie-averaged ranks; 0 if either side is constant."""
    base = df.select(*key_cols, F.col(actual).alias("_y"), F.col(pred).alias("_p"))
    ry = average_rank(base.select(*key_cols, "_y"), "_y", key_cols, "_ry")
    rp = average_rank(base.select(*key_cols, "_p"), "_p", key_cols, "_rp")
    return ry.join(rp, list(key_cols)).agg(
        F.when(F.min("_y") == F.max("_y"), F.lit(0.0))
        .when(F.min("_p") == F.max("_p"), F.lit(0.0))
        .otherwise(pearson_expr(F.col("_ry"), F.col("_rp"))).alias("spearman"))


def top_fraction_capture_expr(actual: Column, rank: Column, n: Column, fraction: float) -> Column:
    """Aggregate: Σ y over the k = max(1, ceil(n*f)) best-ranked / Σ y (0 if Σ y = 0)."""
    k = F.greatest(F.lit(1), F.ceil(n.cast("double") * F.lit(float(fraction))))
    top = F.sum(F.when(rank <= k, actual).otherwise(F.lit(0.0)))
    total = F.sum(actual)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(top, total), F.lit(0.0)))


def with_count(df: DataFrame, name: str = "_n") -> DataFrame:
    """Attach the row count as a column (one-row aggregate, broadcast)."""
    n = df.agg(F.count(F.lit(1)).alias(name))
    return df.crossJoin(F.broadcast(n))


def top_capture(df: DataFrame, actual: str, score: str, key_cols: Sequence[str],
                fractions: Sequence[float] = (0.10, 0.20)) -> DataFrame:
    """Share of the actual value in the best-scored fractions (score descending, key ascending)."""
    order = sorted(fractions)
    cuts = find_cuts(df, score, key_cols, lambda n: [max(1, math.ceil(n * float(f))) for f in order], descending=True)
    place, y, total = cuts.place(), F.col(actual), F.sum(actual)

    def share(f: float) -> Column:
        top = F.sum(F.when(place <= order.index(f), y).otherwise(F.lit(0.0)))
        return F.when(total == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(top, total), F.lit(0.0)))

    return df.agg(*[share(f).alias(f"top_{int(round(f * 100))}_value_capture") for f in fractions])


def interval_coverage(df: DataFrame, actual: str, lower: str, upper: str,
                      prefix: str = "interval") -> DataFrame:
    y = F.col(actual)
    covered = ((y >= F.col(lower)) & (y <= F.col(upper))).cast("double")
    return df.agg(F.avg(covered).alias(f"{prefix}_80_coverage"),
                  F.avg(F.col(upper) - F.col(lower)).alias(f"{prefix}_mean_width"))


def brier(df: DataFrame, active: str, prob: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(prob) - F.col(active), 2)).alias("activity_brier_score"))


def average_precision(df: DataFrame, active: str, prob: str) -> DataFrame:
    """Step-wise average precision Σ (R_i - R_{i-1}) P_i over distinct scores (descending)."""
    per_score = df.groupBy(F.col(prob).alias("_score")).agg(
        F.sum(F.col(active).cast("double")).alias("_tp"), F.count(F.lit(1)).cast("double").alias("_cnt"))
    cum = global_prefix_sum(per_score, [F.col("_score").desc()], ["_tp", "_cnt"])
    return cum.agg(
        F.coalesce(F.try_divide(F.sum(F.col("_tp") * F.col("cum__tp") / F.col("cum__cnt")),
                                F.sum("_tp")), F.lit(0.0)).alias("activity_average_precision"))


def portfolio_checks(df: DataFrame, actual: str, pred: str) -> DataFrame:
    y, p = F.col(actual), F.col(pred)
    total_y = F.sum(y)
    return df.agg(
        F.when(total_y == 0, F.lit(0.0)).otherwise(F.try_divide(F.sum(p), total_y))
        .alias("aggregate_prediction_to_actual_ratio"),
        F.avg((p < 0).cast("double")).alias("negative_prediction_rate"),
        F.avg((y < 0).cast("double")).alias("negative_realized_value_rate"),
    )


def value_ranks(df: DataFrame, value: str, key_cols: Sequence[str], out_col: str) -> DataFrame:
    """(key, tie-averaged ascending rank of the value) of every row; one global sort."""
    return average_rank(df.select(*key_cols, value), value, key_cols, out_col).select(*key_cols, out_col)


def regression_metrics(df: DataFrame, actual: str, pred: str, key_cols: Sequence[str],
                       lower: str | None = None, upper: str | None = None,
                       actual_ranks: DataFrame | None = None) -> DataFrame:
    """One row: mae, wape, rmse, spearman, top-10/20 capture [, coverage, width].

    One global sort by score (descending, key tiebreak) serves both the top-k
    capture and the score's tie-averaged ranks (their correlation with the actual's
    ascending ranks changes its sign).  ``actual_ranks`` (from ``value_ranks``) can be
    shared between scorers evaluated on the same rows.  Rows meet on their key only: a
    value that half of them share is no join key.
    """
    narrow = df.select(*key_cols, *dict.fromkeys(c for c in (actual, pred, lower, upper) if c))
    ranked = with_count(average_rank(narrow, pred, key_cols, "_rp", descending="_rank"))
    y, p = F.col(actual), F.col(pred)
    cols = [
        F.avg(F.abs(y - p)).alias("mae"),
        wape_expr(y, p).alias("wape"),
        F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse"),
        top_fraction_capture_expr(y, F.col("_rank"), F.col("_n"), 0.10).alias("top_10_value_capture"),
        top_fraction_capture_expr(y, F.col("_rank"), F.col("_n"), 0.20).alias("top_20_value_capture"),
    ]
    if lower and upper:
        covered = ((y >= F.col(lower)) & (y <= F.col(upper))).cast("double")
        cols += [F.avg(covered).alias("interval_80_coverage"),
                 F.avg(F.col(upper) - F.col(lower)).alias("interval_mean_width")]
    yr = actual_ranks if actual_ranks is not None else value_ranks(df, actual, key_cols, "_ry")
    both = ranked.join(yr.withColumnRenamed(yr.columns[-1], "_ry"), list(key_cols), "inner")
    cols += [F.when(F.min(y) == F.max(y), F.lit(0.0)).when(F.min(p) == F.max(p), F.lit(0.0))
             .otherwise(pearson_expr(F.col("_ry"), F.col("_n") + F.lit(1) - F.col("_rp"))).alias("spearman")]
    return both.agg(*cols)


def to_long(wide: DataFrame, group: str | None = None, group_col: str = "scorer") -> DataFrame:
    """Wide one-row metrics -> (scorer, metric, value) rows."""
    metrics = [c for c in wide.columns]
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                  for m in metrics]))
    out = wide.select(stacked.alias("_kv")).select("_kv.metric", "_kv.value")
    if group is not None:
        out = out.select(F.lit(group).alias(group_col), "metric", "value")
    return out


def assign_deciles(df: DataFrame, score: str, key_cols: Sequence[str], out_col: str = "predicted_value_decile",
                   bins: int = 10) -> DataFrame:
    """Equal-frequency score bins, 1 = lowest; ties ordered by key (rank 'first').

    Bin b ends at rank floor(b * (n - 1) / bins) + 1, the integer form of
    ``ranking.decile_from_rank``; rows are labelled by comparing with these bins - 1 rows.
    """
    cuts = find_cuts(df, score, key_cols, lambda n: [b * (n - 1) // bins + 1 for b in range(1, bins)])
    return df.withColumn(out_col, (cuts.place() + F.lit(1)).cast("int"))


def interval_diagnostics(df: DataFrame, group_col: str, actual: str, raw_lower: str, raw_upper: str,
                         lower: str, upper: str, id_col: str = "customer_id") -> DataFrame:
    """Per group: customers, raw/calibrated coverage and mean width."""
    missing = {group_col, actual, raw_lower, raw_upper, lower, upper} - set(df.columns)
    if missing:
        raise ValueError(f"interval diagnostics need columns that are absent: {sorted(missing)}")
    y = F.col(actual)
    raw_cov = ((y >= F.col(raw_lower)) & (y <= F.col(raw_upper))).cast("double")
    cal_cov = ((y >= F.col(lower)) & (y <= F.col(upper))).cast("double")
    return df.groupBy(group_col).agg(
        F.count(id_col).alias("customers"),
        F.avg(raw_cov).alias("raw_coverage"),
        F.avg(cal_cov).alias("calibrated_coverage"),
        F.avg(F.col(raw_upper) - F.col(raw_lower)).alias("raw_mean_width"),
        F.avg(F.col(upper) - F.col(lower)).alias("calibrated_mean_width"),
    )


def decile_value_summary(df: DataFrame, decile_col: str, actual: str, pred: str,
                         id_col: str = "customer_id") -> DataFrame:
    """Per decile: customers, mean predicted, mean realized, Σ realized, share of total."""
    per = df.groupBy(decile_col).agg(
        F.count(id_col).alias("customers"),
        F.avg(pred).alias("average_predicted_value"),
        F.avg(actual).alias("average_realized_value"),
        F.sum(actual).alias("realized_value"),
    )
    total = df.agg(F.sum(actual).alias("_total"))
    return per.crossJoin(F.broadcast(total)).withColumn(
        "realized_value_share", F.try_divide(F.col("realized_value"), F.col("_total"))).drop("_total")


def capture_curve(df: DataFrame, actual: str, score: str, key_cols: Sequence[str],
                  points: int = 100) -> DataFrame:
    """Cumulative share of realized value captured by the top p% (p = 1..points) customers.

    Point p ends at rank ceil(p * n / points), so a row's point follows from its place
    among points - 1 cuts; a sum per point (<= points rows) and a running sum over
    the points give the curve.
    """
    cuts = find_cuts(df, score, key_cols, lambda n: [-(-p * n // points) for p in range(1, points)], descending=True)
    ranked = df.select((cuts.place() + F.lit(1)).cast("int").alias("coverage_point"), F.col(actual).alias("_y"))
    per_point = ranked.groupBy("coverage_point").agg(F.sum("_y").alias("_v"), F.count(F.lit(1)).alias("_c"))
    total = df.agg(F.sum(actual).alias("_total"), F.count(F.lit(1)).alias("_n"))
    grid = df.sparkSession.range(1, points + 1).select(F.col("id").cast("int").alias("coverage_point"))
    w = Window.orderBy("coverage_point").rowsBetween(Window.unboundedPreceding, 0)
    curve = (grid.join(per_point, "coverage_point", "left")
             .select("coverage_point", F.sum(F.coalesce("_v", F.lit(0.0))).over(w).alias("_cv"),
                     F.sum(F.coalesce("_c", F.lit(0))).over(w).alias("customers")))
    return curve.crossJoin(F.broadcast(total)).select(
        "coverage_point",
        F.col("customers").cast("bigint").alias("customers"),
        (F.col("customers") / F.col("_n")).alias("customer_share"),
        F.try_divide(F.col("_cv"), F.col("_total")).alias("captured_value_share"),
    )
