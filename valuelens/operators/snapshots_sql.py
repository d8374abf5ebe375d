"""Margin snapshots through the SQL surface (A6 + D0): registered views, a parameter
view with one row per snapshot date, and range predicates as join conditions.

The statement reads the orders once. Every order near a snapshot becomes an event with
its age in days (0 on the snapshot's day, negative behind it); features and labels are
filtered aggregates over the events of a customer and snapshot. The outer date bounds
are literals, so the scan is pruned before the join with the parameter view, which is
broadcast (one row per configured date).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dates import parse_dates
from .snapshots_margin import MARGIN_FEATURES, MARGIN_LABELS


def _statement(names: dict[str, str], first: str, last: str, lookback: int, horizon: int, rate: float) -> str:
    def within(days: int, start: int = 0) -> str:
        return f"FILTER (WHERE age BETWEEN {start} AND {days - 1})"

    picks = [f"count(DISTINCT order_id) {within(d)} AS orders_{d}d" for d in (30, 90, 180)]
    picks += [f"count(DISTINCT {c}) {within(lookback)} AS {n}_365d" for n, c in
              (("orders", "order_id"), ("category_diversity", "category"), ("active_months", "date_format(order_date, 'yyyyMM')"))]
    picks += [f"sum({c}) {within(d)} AS {n}_{label}d" for n, c in (("revenue", "net_revenue"), ("margin", "contribution_margin"))
              for label, d in ((90, 90), (180, 180), (365, lookback))]
    picks += [f"avg({c}) {within(lookback)} AS {n}_365d" for n, c in
              (("average_order_value", "net_revenue"), ("average_discount", "discount_ratio"), ("return_rate", "returned"))]
    picks += [f"sum(contribution_margin) {within(180, 90)} AS margin_previous_90d", f"min(age) {within(lookback)} AS last_age",
              "count(DISTINCT order_id) FILTER (WHERE age < 0) AS future_orders_180d",
              f"sum(contribution_margin / (1 - {float(rate)!r}D * age / 365)) FILTER (WHERE age < 0) AS future_discounted_margin_180d"]
    return f"""
    WITH near AS (
      SELECT * FROM {names['orders']} WHERE order_date BETWEEN DATE '{first}' AND DATE '{last}'),
    event AS (
      SELECT near.*, snapshot_date, datediff(snapshot_date, order_date) AS age
      FROM near JOIN {names['params']} ON datediff(snapshot_date, order_date) BETWEEN {-horizon} AND {lookback - 1}),
    summed AS (SELECT customer_id, snapshot_date, {', '.join(picks)} FROM event GROUP BY customer_id, snapshot_date)
    SELECT who.*, {names['params']}.snapshot_date, summed.* EXCEPT (customer_id, snapshot_date)
    FROM {names['customers']} AS who
    JOIN {names['params']} ON who.acquisition_date <= {names['params']}.snapshot_date
    LEFT JOIN summed ON summed.customer_id = who.customer_id AND summed.snapshot_date = {names['params']}.snapshot_date"""


def margin_snapshots_sql(customers: DataFrame, orders: DataFrame, snapshot_dates: Sequence,
                         lookback_days: int = 365, horizon_days: int = 180,
                         annual_discount_rate: float = 0.10, view_prefix: str = "vl") -> DataFrame:
    spark = orders.sparkSession
    dates = parse_dates(snapshot_dates)
    L, H = int(lookback_days), int(horizon_days)
    names = {k: f"{view_prefix}_{k}" for k in ("params", "orders", "customers")}
    F.broadcast(spark.createDataFrame([(d,) for d in dates], "snapshot_date date")).createOrReplaceTempView(names["params"])
    orders.createOrReplaceTempView(names["orders"])
    customers.select("customer_id", "acquisition_date", "acquisition_channel", "region").createOrReplaceTempView(names["customers"])
    bounds = (min(dates) - timedelta(days=L - 1)).isoformat(), (max(dates) + timedelta(days=H)).isoformat()
    rows = spark.sql(_statement(names, *bounds, L, H, annual_discount_rate))
    kinds = {c: "bigint" for c in rows.columns if c.startswith(("orders_", "category_", "active_", "future_orders"))}
    kinds |= {c: "double" for c in rows.columns if c.startswith(("revenue_", "margin_", "average_", "return_", "future_discounted"))}
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(t) for c, t in kinds.items()})
    return rows.withColumns({
        "tenure_days": F.datediff("snapshot_date", "acquisition_date").cast("bigint"),
        "recency_days": F.coalesce("last_age", F.lit(L + 1)).cast("bigint"),
        "margin_momentum_90d": F.col("margin_90d") - F.col("margin_previous_90d"),
        "recent_order_share": F.coalesce(F.try_divide(F.col("orders_90d").cast("double"), F.col("orders_365d")), F.lit(0.0)),
        "future_active_180d": (F.col("future_orders_180d") > 0).cast("int"),
    }).select("customer_id", "snapshot_date", *MARGIN_FEATURES, *MARGIN_LABELS)
