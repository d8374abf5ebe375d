"""Readers for the supplied Parquet tables and the fixture mappings onto the
customer-value schemas (orders, customers, canonical transactions, raw lines).

Every mapping is a declarative plan over the whole tables: Catalyst prunes the
columns at the scan and AQE chooses join strategies from runtime sizes, so no
table whose size grows with the data is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLE_NAMES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin-path order log: one row per order that has lines.

    order_id, customer_id, order_date, category, order_channel, net_revenue,
    contribution_margin, discount_ratio (highest line discount), returned.  Money is
    summed as DECIMAL(18,4) (exact, order independent), rounded to cents and exposed
    as double.
    """
    line = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                                        "o_orderpriority")
    # an order's few lines seldom meet before the shuffle: they are dealt out first and sorted once
    per_order = (
        line.join(part, line.l_partkey == part.p_partkey, "inner")
        .select(
            "l_orderkey", "p_type", "l_discount",
            (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).cast("decimal(18,4)").alias("_net"),
            (F.lit(0.8) * F.col("p_retailprice") * F.col("l_quantity")).cast("decimal(18,4)").alias("_cost"),
            (F.col("l_returnflag") == "R").cast("int").alias("_back"),
        )
        .repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(
            F.min("p_type").alias("category"),
            F.sum("_net").alias("_net"),
            F.sum("_cost").alias("_cost"),
            F.max("l_discount").alias("_disc"),
            F.max("_back").alias("returned"),
        )
    )
    return (
        orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "inner")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.to_date("o_orderdate").alias("order_date"),
            "category",
            F.col("o_orderpriority").alias("order_channel"),
            F.round("_net", 2).cast("double").alias("net_revenue"),
            F.round(F.col("_net") - F.col("_cost"), 2).cast("double").alias("contribution_margin"),
            F.col("_disc").alias("discount_ratio"),
            "returned",
        )
    )


def customers_fixture(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Margin-path customer table: id, acquisition date (first order), channel, region."""
    orders = orders if orders is not None else orders_fixture(spark, sf_dir)
    first = orders.groupBy("customer_id").agg(F.min("order_date").alias("acquisition_date"))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey, "inner")
    return (
        cust.join(geo, cust.c_nationkey == geo.n_nationkey, "inner")
        .join(first, cust.c_custkey == first.customer_id, "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            "acquisition_date",
            F.col("c_mktsegment").alias("acquisition_channel"),
            F.col("r_name").alias("region"),
        )
    )


def _transaction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey, "inner")
        .join(part, line.l_partkey == part.p_partkey, "inner")
        .join(supplier, line.l_suppkey == supplier.s_suppkey, "inner")
        .join(nation, supplier.s_nationkey == nation.n_nationkey, "inner")
    )


def transactions_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue-path canonical transactions (10 contract columns), one row per line."""
    lines = _transaction_lines(spark, sf_dir)
    cancel = F.col("l_returnflag") == "R"
    qty = F.when(cancel, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    value = F.abs(qty) * F.col("p_retailprice")
    return lines.select(
        F.col("l_orderkey").cast("string").alias("invoice_id"),
        F.col("l_partkey").cast("string").alias("stock_code"),
        qty.cast("double").alias("quantity"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("invoice_date"),
        F.col("p_retailprice").cast("double").alias("unit_price"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("n_name").alias("country"),
        cancel.alias("is_cancellation"),
        F.when(cancel, -value).otherwise(value).alias("signed_revenue"),
        F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("early"))
        .otherwise(F.lit("late")).alias("source_sheet"),
    )


RAW_COLUMNS = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price",
               "Customer ID", "Country", "source_sheet"]


def raw_lines_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw source lines (all strings) with deterministic defects keyed on the order key.

    Defects: %23 customer missing, %29 price '0', %31 quantity 'abc', %37 bad date,
    %41 padded invoice, %43 invoice prefixed 'C'; %50 lines appear twice (exact
    duplicates); %53 lines appear again under the other source name; of %3 orders the
    date has the form month/day/year hour:minute, of %7 ones year/month/day.
    """
    lines = _transaction_lines(spark, sf_dir)
    k = F.col("l_orderkey")
    cancel = F.col("l_returnflag") == "R"
    qty = F.when(cancel, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    invoice = F.col("l_orderkey").cast("string")
    invoice = F.when(k % 41 == 0, F.concat(F.lit("  "), invoice, F.lit(" "))) \
        .when(k % 43 == 0, F.concat(F.lit("C"), invoice)).otherwise(invoice)
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    sheet = F.when(early, F.lit("early")).otherwise(F.lit("late"))
    other = F.when(early, F.lit("late")).otherwise(F.lit("early"))
    # every line once; %50 lines a second time; %53 lines again under the other source
    copies = F.filter(F.array(F.struct(F.lit(True).alias("keep"), sheet.alias("sheet")),
                              F.struct((k % 50 == 0).alias("keep"), sheet.alias("sheet")),
                              F.struct((k % 53 == 0).alias("keep"), other.alias("sheet"))),
                      lambda x: x["keep"])
    return lines.select(
        invoice.alias("Invoice"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("Description"),
        F.when(k % 31 == 0, F.lit("abc")).otherwise(qty.cast("string")).alias("Quantity"),
        F.when(k % 37 == 0, F.lit("not a date")).when(k % 3 == 0, F.date_format("o_orderdate", "M/d/yyyy H:mm"))
        .when(k % 7 == 0, F.date_format("o_orderdate", "yyyy/M/d"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("InvoiceDate"),
        F.when(k % 29 == 0, F.lit("0")).otherwise(F.col("p_retailprice").cast("string")).alias("Price"),
        F.when(k % 23 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("Customer ID"),
        F.col("n_name").alias("Country"),
        F.explode(copies).alias("_copy"),
    ).withColumn("source_sheet", F.col("_copy.sheet")).drop("_copy")
