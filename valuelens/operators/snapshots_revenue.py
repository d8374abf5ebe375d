"""As-of customer snapshots, revenue path (signed net revenue, cancellations kept).

Semantics per snapshot ``s`` (midnight), lookback ``L`` and horizon ``H`` days,
with ``t`` the line timestamp and "positive" = not cancelled and revenue > 0:
  history window  s - L <= t < s        (same-day rows belong to the label)
  label window    s <= t < s + H
  eligible        some positive line with t < s, any age
  country         country of the latest line (any kind) with t < s
  age_days        calendar days between to_date(t) and s

One pass for all dates.  Each line is routed to
  * every snapshot whose history or label window contains it, and
  * its *as-of bucket*: the first snapshot after it (s_{i-1} <= t < s_i).
A first ``groupBy(customer_id, snapshot_date)`` computes window features, labels
and per-bucket as-of summaries.  A second, small aggregation (rows per customer
are bounded by the number of dates) rolls the bucket summaries forward so that
snapshot ``j`` sees every bucket ``i <= j``: eligibility and latest country over
the whole history cost one pass instead of one pass per date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import parse_dates

REVENUE_CATEGORICAL = ["country"]
REVENUE_NUMERIC = [
    "observed_tenure_days", "recency_days", "orders_30d", "orders_90d", "orders_180d",
    "orders_365d", "net_revenue_90d", "net_revenue_previous_90d", "net_revenue_180d",
    "net_revenue_365d", "average_order_value_365d", "return_value_ratio_365d",
    "product_diversity_365d", "active_months_365d", "revenue_momentum_90d", "recent_order_share",
]
REVENUE_FEATURES = REVENUE_CATEGORICAL + REVENUE_NUMERIC
REVENUE_TARGET = "future_net_revenue_180d"
REVENUE_ACTIVE = "future_active_180d"
REVENUE_LABELS = [REVENUE_TARGET, REVENUE_ACTIVE]

CANONICAL_COLUMNS = ["invoice_id", "stock_code", "quantity", "invoice_date", "unit_price",
                     "customer_id", "country", "is_cancellation", "signed_revenue", "source_sheet"]

_WINDOW_COLS = ["_min_age", "orders_30d", "orders_90d", "orders_180d", "orders_365d",
                "net_revenue_90d", "net_revenue_previous_90d", "net_revenue_180d",
                "net_revenue_365d", "_gross_365", "_returned_365", "product_diversity_365d",
                "active_months_365d", "_future_value", "_future_lines"]


def _param_array(dates) -> Column:
    """array<struct<s: date, prev: date>> of the configured snapshots."""
    items = []
    prev = None
    for d in dates:
        items.append(F.struct(F.lit(d.isoformat()).cast("date").alias("s"),
                              (F.lit(prev.isoformat()).cast("date") if prev else F.lit(None).cast("date"))
                              .alias("prev")))
        prev = d
    return F.array(*items)


def _snapshot_aggregates(transactions: DataFrame, dates, L: int, H: int,
                         features: bool, labels: bool) -> DataFrame:
    t = F.col("invoice_date")

    def ts(c: Column) -> Column:
        return c.cast("timestamp_ntz")

    def keep(x: Column) -> Column:
        s = x["s"]
        in_bucket = (t < ts(s)) & (x["prev"].isNull() | (t >= ts(x["prev"])))
        cond = in_bucket
        if features:
            cond = cond | ((t >= ts(F.date_sub(s, L))) & (t < ts(s)))
        if labels:
            cond = cond | ((t >= ts(s)) & (t < ts(F.date_add(s, H))))
        return cond

    last = dates[-1]
    upper = ts(F.date_add(F.lit(last.isoformat()).cast("date"), H if labels else 0))
    routed = (
        transactions.filter(t < upper)
        .select("customer_id", "invoice_id", "stock_code", "invoice_date", "country",
                "is_cancellation", "signed_revenue",
                F.explode(F.filter(_param_array(dates), keep)).alias("_p"))
        .select("*", F.col("_p.s").alias("snapshot_date"), F.col("_p.prev").alias("_prev"))
        .drop("_p")
        .withColumn("_age", F.datediff(F.col("snapshot_date"), F.to_date("invoice_date")))
    )
    positive = "(NOT is_cancellation AND signed_revenue > 0)"
    snap = "CAST(snapshot_date AS TIMESTAMP_NTZ)"
    bucket = f"(invoice_date < {snap} AND (_prev IS NULL OR invoice_date >= CAST(_prev AS TIMESTAMP_NTZ)))"
    hist = f"(invoice_date < {snap} AND invoice_date >= CAST(date_sub(snapshot_date, {L}) AS TIMESTAMP_NTZ))"
    future = f"(invoice_date >= {snap} AND invoice_date < CAST(date_add(snapshot_date, {H}) AS TIMESTAMP_NTZ))"
    used = f"{hist} AND {positive} AND _age <= 365"
    values = [F.struct(F.lit("line").alias("kind"), F.lit(None).cast("string").alias("value"))]
    if features:      # level 1: one row per invoice, product and month, with the least age; sums stay with "line"
        values += [F.expr(f"named_struct('kind', '{kind}', 'value', IF({used}, CAST({value} AS STRING), NULL))") for kind, value in
                   (("invoice", "invoice_id"), ("product", "stock_code"), ("month", "date_trunc('MONTH', invoice_date)"))]
    spread = routed.select("*", F.inline(F.array(*values)).alias("_kind", "_value")).where("_kind = 'line' OR _value IS NOT NULL")
    line = "_kind = 'line'"
    sums = {"_first_pos": ("min", "invoice_date", f"{bucket} AND {positive}")}
    if features:
        sums |= {
            "_min_age": ("min", "_age", f"{hist} AND {positive}"),
            "net_revenue_90d": ("sum", "signed_revenue", f"{hist} AND _age <= 90"),
            "net_revenue_previous_90d": ("sum", "signed_revenue", f"{hist} AND _age > 90 AND _age <= 180"),
            "net_revenue_180d": ("sum", "signed_revenue", f"{hist} AND _age <= 180"),
            "net_revenue_365d": ("sum", "signed_revenue", f"{hist} AND _age <= 365"),
            "_gross_365": ("sum", "signed_revenue", used),
            "_returned_365": ("sum", "signed_revenue", f"{hist} AND is_cancellation AND _age <= 365"),
        }
    if labels:
        sums |= {"_future_value": ("sum", "signed_revenue", future), "_future_lines": ("sum", "1", future)}
    least = [F.min("_age").alias("_least")] if features else []
    single = spread.groupBy("customer_id", "snapshot_date", "_kind", "_value").agg(
        *[F.expr(f"{fn}({what}) FILTER (WHERE {line} AND {cond})").alias(name) for name, (fn, what, cond) in sums.items()], *least)
    aggs = [F.expr(f"{fn}({name})").alias(name) for name, (fn, _, _) in sums.items()]
    if features:
        def count(kind: str, days: int) -> Column:
            return F.count_if((F.col("_kind") == kind) & (F.col("_least") <= days))
        aggs += [*[count("invoice", d).alias(f"orders_{d}d") for d in (30, 90, 180, 365)],
                 count("product", 365).alias("product_diversity_365d"), count("month", 365).alias("active_months_365d")]
    main = single.groupBy("customer_id", "snapshot_date").agg(*aggs)
    return main.join(_latest_per_bucket(transactions, dates), ["customer_id", "snapshot_date"], "left")


def _latest_per_bucket(transactions: DataFrame, dates) -> DataFrame:
    """Latest line per (customer, as-of bucket), ties broken by (invoice, stock, country).

    Kept apart from the main aggregation: a max over a struct has no fixed-width
    buffer and would push every aggregate onto the sort-based path.  Each line
    belongs to exactly one bucket, so this pass reads every line once.
    """
    t = F.col("invoice_date")
    bucket = F.lit(None).cast("date")
    for d in reversed(dates):
        bucket = F.when(t < F.lit(d.isoformat()).cast("date").cast("timestamp_ntz"),
                        F.lit(d.isoformat()).cast("date")).otherwise(bucket)
    last = F.lit(dates[-1].isoformat()).cast("date").cast("timestamp_ntz")
    return (transactions.filter(t < last)          # static bound: pushed to the scan
            .select("customer_id", bucket.alias("snapshot_date"),
                                F.struct("invoice_date", "invoice_id", "stock_code", "country").alias("_k"))
            .filter(F.col("snapshot_date").isNotNull())
            .groupBy("customer_id", "snapshot_date").agg(F.max("_k").alias("_latest")))


def _roll_forward(agg: DataFrame, dates, carried: list[str]) -> DataFrame:
    """Per (customer, s_j): as-of summaries over buckets s_i <= s_j, and the window
    columns of s_j itself.  Input rows per customer <= len(dates)."""
    later = F.filter(F.array(*[F.lit(d.isoformat()).cast("date") for d in dates]),
                     lambda s: s >= F.col("snapshot_date"))
    spread = agg.select("*", F.explode(later).alias("_target"))
    same = F.col("snapshot_date") == F.col("_target")
    outs = [F.min("_first_pos").alias("_first_pos"), F.max("_latest").alias("_latest")]
    outs += [F.max(F.when(same, F.col(c))).alias(c) for c in carried]
    return (spread.groupBy("customer_id", "_target").agg(*outs)
            .withColumnRenamed("_target", "snapshot_date")
            .filter(F.col("_first_pos").isNotNull()))


def _feature_columns(L: int) -> list[Column]:
    def z(c: str, typ: str = "bigint") -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast(typ)
    net90, prev90 = z("net_revenue_90d", "double"), z("net_revenue_previous_90d", "double")
    o365 = z("orders_365d")
    net365 = z("net_revenue_365d", "double")
    return [
        F.col("_latest.country").alias("country"),
        F.datediff(F.col("snapshot_date"), F.to_date("_first_pos")).cast("bigint").alias("observed_tenure_days"),
        F.coalesce(F.col("_min_age").cast("bigint"), F.lit(L + 1).cast("bigint")).alias("recency_days"),
        z("orders_30d").alias("orders_30d"), z("orders_90d").alias("orders_90d"),
        z("orders_180d").alias("orders_180d"), o365.alias("orders_365d"),
        net90.alias("net_revenue_90d"), prev90.alias("net_revenue_previous_90d"),
        z("net_revenue_180d", "double").alias("net_revenue_180d"), net365.alias("net_revenue_365d"),
        F.coalesce(F.try_divide(net365, F.nullif(o365, F.lit(0))), F.lit(0.0))
        .alias("average_order_value_365d"),
        F.coalesce(F.try_divide(-F.col("_returned_365"), F.nullif(F.col("_gross_365"), F.lit(0.0))),
                   F.lit(0.0)).alias("return_value_ratio_365d"),
        z("product_diversity_365d").alias("product_diversity_365d"),
        z("active_months_365d").alias("active_months_365d"),
        ((net90 - prev90) / (F.abs(net90) + F.abs(prev90) + F.lit(1.0))).alias("revenue_momentum_90d"),
        F.coalesce(F.try_divide(z("orders_90d").cast("double"), F.nullif(o365, F.lit(0))), F.lit(0.0))
        .alias("recent_order_share"),
    ]


def _label_columns() -> list[Column]:
    return [
        F.coalesce(F.col("_future_value"), F.lit(0.0)).cast("double").alias(REVENUE_TARGET),
        (F.coalesce(F.col("_future_lines"), F.lit(0)) > 0).cast("int").alias(REVENUE_ACTIVE),
    ]


def revenue_snapshots(transactions: DataFrame, snapshot_dates: Sequence, lookback_days: int = 365,
                      horizon_days: int = 180, features: bool = True, labels: bool = True) -> DataFrame:
    """Snapshot table keyed by (customer_id, snapshot_date) for eligible customers."""
    if int(lookback_days) <= 0 or int(horizon_days) <= 0:
        raise ValueError("lookback_days and horizon_days must be positive")
    dates = parse_dates(snapshot_dates)
    L, H = int(lookback_days), int(horizon_days)
    agg = _snapshot_aggregates(transactions, dates, L, H, features, labels)
    carried = [c for c in _WINDOW_COLS if c in agg.columns]
    rolled = _roll_forward(agg, dates, carried)
    cols: list = ["customer_id", "snapshot_date"]
    if features:
        cols += _feature_columns(L)
    else:
        cols += [F.col("_latest.country").alias("country"),
                 F.col("_first_pos").alias("first_purchase_date")]
    if labels:
        cols += _label_columns()
    return rolled.select(*cols)


def eligible_customers(transactions: DataFrame, snapshot_dates: Sequence) -> DataFrame:
    """(customer_id, snapshot_date, first_purchase_date, country) as of each date."""
    dates = parse_dates(snapshot_dates)
    agg = _snapshot_aggregates(transactions, dates, 1, 1, False, False)
    return _roll_forward(agg, dates, []).select(
        "customer_id", "snapshot_date", F.col("_first_pos").alias("first_purchase_date"),
        F.col("_latest.country").alias("country"))


def revenue_features(transactions, snapshot_dates, lookback_days=365) -> DataFrame:
    return revenue_snapshots(transactions, snapshot_dates, lookback_days, 180, True, False)


def revenue_labels(transactions, snapshot_dates, horizon_days=180) -> DataFrame:
    return revenue_snapshots(transactions, snapshot_dates, 365, horizon_days, False, True) \
        .drop("country", "first_purchase_date")
