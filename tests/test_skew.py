"""Hot keys: one value / one customer holding a third of all rows."""

import datetime as dt

from pyspark.sql import functions as F

from valuelens.operators import evaluation as ev
from valuelens.operators import snapshots_margin as sm
from valuelens.operators.ranking import global_rank


def test_hot_score_value_is_split_across_ranges(spark):
    n = 3000
    df = spark.range(0, n).select(F.col("id").alias("k"),
                                  F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.col("id") / 7.0).alias("v"))
    sizes = [r["count"] for r in df.repartitionByRange(6, "v", "k")
             .groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < n / 3            # the 1000 tied rows do not land in one range
    ranked = global_rank(df, ["v", "k"], partitions=6)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, n + 1))
    deciles = ev.assign_deciles(df, "v", ["k"]).groupBy("predicted_value_decile").count().collect()
    assert sorted(r["count"] for r in deciles) == [300] * 10


def test_hot_customer_snapshot_is_exact(spark):
    base = dt.date(2020, 1, 1)
    rows = []
    for i in range(900):
        cust = "HOT" if i % 3 == 0 else f"C{i % 50}"
        rows.append((f"O{i}", cust, base + dt.timedelta(days=i % 400), "cat", "web", 10.0, 1.0, 0.0, 0))
    orders = spark.createDataFrame(rows, "order_id string, customer_id string, order_date date, category string, "
                                         "order_channel string, net_revenue double, contribution_margin double, "
                                         "discount_ratio double, returned int")
    customers = orders.groupBy("customer_id").agg(F.min("order_date").alias("acquisition_date")) \
        .withColumn("acquisition_channel", F.lit("x")).withColumn("region", F.lit("y"))
    snap = sm.margin_snapshots(customers, orders.repartition(7), ["2020-12-31"], 365, 180, 0.1)
    hot = snap.filter("customer_id = 'HOT'").first()
    hot_orders = [r for r in rows if r[1] == "HOT" and dt.date(2020, 12, 31) - dt.timedelta(days=365) < r[2] <= dt.date(2020, 12, 31)]
    assert hot["orders_365d"] == len(hot_orders)
    assert hot["revenue_365d"] == 10.0 * len(hot_orders)
