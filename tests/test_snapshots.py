"""As-of snapshot semantics on small hand-made tables; expectations are worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from valuelens.operators import contract as ct
from valuelens.operators import snapshots_margin as sm
from valuelens.operators import snapshots_revenue as sr

D = dt.date


def _margin_inputs(spark, next_margin=73.0):
    customers = spark.createDataFrame(
        [("K7", D(2030, 2, 3), "mail", "east"), ("K8", D(2030, 5, 20), "shop", "west"), ("K9", D(2031, 1, 1), "mail", "west")],
        "customer_id string, acquisition_date date, acquisition_channel string, region string")
    orders = spark.createDataFrame(
        [("a", "K7", D(2030, 2, 3), "tools", "web", 64.0, 16.0, 0.25, 1),     # 150 days before 2030-07-03
         ("b", "K7", D(2030, 6, 13), "garden", "web", 36.0, 9.0, 0.0, 0),      # 20 days before
         ("c", "K7", D(2030, 7, 3), "tools", "shop", 20.0, 5.0, 0.05, 0),      # the day itself counts as past
         ("d", "K7", D(2030, 9, 14), "tools", "web", 200.0, next_margin, 0.0, 0),   # 73 days after
         ("e", "K8", D(2030, 12, 30), "books", "web", 11.0, 3.0, 0.0, 0),      # 180 days after: last day of the horizon
         ("f", "K8", D(2030, 12, 31), "books", "web", 11.0, 3.0, 0.0, 0)],     # one day too late
        "order_id string, customer_id string, order_date date, category string, order_channel string, "
        "net_revenue double, contribution_margin double, discount_ratio double, returned int")
    return customers, orders


def _rows(df):
    return {r["customer_id"]: r for r in df.collect()}


def test_margin_windows_and_discounted_label(spark):
    customers, orders = _margin_inputs(spark)
    rows = _rows(sm.margin_snapshots(customers, orders, ["2030-07-03"], 365, 180, 0.20))
    assert set(rows) == {"K7", "K8"}                                  # K9 joins later
    a = rows["K7"]
    assert (a["orders_30d"], a["orders_90d"], a["orders_180d"], a["orders_365d"]) == (2, 2, 3, 3)
    assert (a["revenue_90d"], a["margin_90d"], a["margin_previous_90d"], a["margin_365d"]) == (56.0, 14.0, 16.0, 30.0)
    assert (a["recency_days"], a["tenure_days"], a["category_diversity_365d"], a["active_months_365d"]) == (0, 150, 2, 3)
    assert a["average_order_value_365d"] == pytest.approx(40.0) and a["average_discount_365d"] == pytest.approx(0.10)
    assert a["return_rate_365d"] == pytest.approx(1 / 3) and a["recent_order_share"] == pytest.approx(2 / 3)
    # 73 days is a fifth of a year: 73 / (1 + 0.2 * 0.2)
    assert a["future_orders_180d"] == 1 and a["future_discounted_margin_180d"] == pytest.approx(73 / 1.04)
    b = rows["K8"]
    assert b["orders_365d"] == 0 and b["recency_days"] == 366 and b["recent_order_share"] == 0.0
    assert b["future_orders_180d"] == 1 and b["future_active_180d"] == 1


def test_margin_loss_making_future_is_still_active(spark):
    customers, orders = _margin_inputs(spark, next_margin=-26.0)
    a = _rows(sm.margin_snapshots(customers, orders, ["2030-07-03"], 365, 180, 0.20))["K7"]
    assert a["future_discounted_margin_180d"] == pytest.approx(-25.0) and a["future_active_180d"] == 1


def test_margin_one_pass_equals_separate_plans_and_sql(spark):
    from valuelens.operators.snapshots_sql import margin_snapshots_sql
    customers, orders = _margin_inputs(spark)
    dates = ["2030-07-03", "2030-09-14", "2031-03-01"]
    a = sm.margin_snapshots(customers, orders, dates)
    b = sm.margin_snapshots_by_join(customers, orders, dates)
    c = margin_snapshots_sql(customers, orders, dates)
    assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())
    assert a.columns == c.columns
    for x, y in zip(sorted(a.collect()), sorted(c.collect())):
        assert all(u == pytest.approx(v) if isinstance(u, float) else u == v for u, v in zip(x, y))
    assert a.count() == a.select("customer_id", "snapshot_date").distinct().count()


def _transactions(spark):
    rows = [  # invoice, stock, quantity, time, price, customer, country, cancelled
        ("701", "nut", 4, "2031-02-10 08:30:00", 2.5, "51", "Peru", False),       # 10.0, long before
        ("702", "nut", 3, "2031-11-05 09:00:00", 4.0, "51", "Peru", False),       # 12.0, 57 days before 2032-01-01
        ("703", "bolt", 2, "2031-12-22 17:45:00", 9.0, "51", "Chile", False),     # 18.0, 10 days before
        ("C70", "bolt", -1, "2031-12-30 12:00:00", 9.0, "51", "Chile", True),     # -9.0, 2 days before
        ("704", "gear", 1, "2032-01-01 00:00:00", 7.0, "51", "Chile", False),     # the day itself is the future
        ("C71", "gear", -3, "2032-02-02 10:00:00", 7.0, "51", "Chile", True),     # -21.0
        ("801", "nut", 1, "2031-10-01 10:00:00", 6.0, "52", "Oman", False),
        ("802", "nut", 5, "2032-03-30 23:59:59", 6.0, "52", "Oman", False),       # day 89
        ("803", "nut", 5, "2032-03-31 00:00:00", 6.0, "52", "Oman", False),       # day 90: past the horizon
        ("C90", "nut", -1, "2031-12-01 10:00:00", 5.0, "53", "Fiji", True),       # never bought anything
    ]
    df = spark.createDataFrame([(i, s, float(q), t, p, c, n, x, q * p, "s") for i, s, q, t, p, c, n, x in rows],
                               "invoice_id string, stock_code string, quantity double, ts string, unit_price double, customer_id string, "
                               "country string, is_cancellation boolean, signed_revenue double, source_sheet string")
    return df.withColumn("invoice_date", F.col("ts").cast("timestamp_ntz")).drop("ts")


def test_revenue_day_rule_and_labels(spark):
    rows = _rows(sr.revenue_snapshots(_transactions(spark), ["2032-01-01"], 365, 90))
    assert set(rows) == {"51", "52"}
    a = rows["51"]
    assert (a["orders_30d"], a["orders_90d"], a["orders_365d"]) == (1, 2, 3)
    assert (a["net_revenue_90d"], a["net_revenue_previous_90d"], a["net_revenue_365d"]) == (21.0, 0.0, 31.0)
    assert a["return_value_ratio_365d"] == pytest.approx(9 / 40) and a["average_order_value_365d"] == pytest.approx(31 / 3)
    assert a["country"] == "Chile" and a["recency_days"] == 10 and a["observed_tenure_days"] == 325
    assert a["future_net_revenue_180d"] == -14.0 and a["future_active_180d"] == 1
    assert rows["52"]["future_net_revenue_180d"] == 30.0


def test_revenue_eligibility_uses_whole_history(spark):
    rows = _rows(sr.revenue_snapshots(_transactions(spark), ["2031-06-10"], 45, 90))
    assert set(rows) == {"51"}                                        # bought 120 days before, outside the lookback
    assert rows["51"]["recency_days"] == 46 and rows["51"]["orders_365d"] == 0
    assert rows["51"]["observed_tenure_days"] == 120 and rows["51"]["future_active_180d"] == 0


def test_lookback_gate_rejects_incomplete_history(spark):
    tx = _transactions(spark)
    late = tx.filter(F.col("invoice_date") >= F.lit("2031-10-01").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="lookback"):
        ct.lookback_gate(late, ["2032-01-01"], 200)
    ct.lookback_gate(tx, ["2032-01-01"], 200)


def test_snapshot_validation_counts(spark):
    dates = ["2032-01-01", "2032-02-01"]
    snap = sr.revenue_snapshots(_transactions(spark), dates, 365, 90)
    r = ct.snapshot_checks(snap, dates, binary_col="future_active_180d").first()
    assert r["duplicate_keys"] == 0 and r["null_values"] == 0 and r["nonfinite_values"] == 0
    assert r["missing_dates"] == 0 and r["nonbinary_active_rows"] == 0
    with pytest.raises(ValueError):
        ct.validate_snapshots(snap.unionByName(snap), dates)
