"""Shared plumbing for registered queries: fixed parameters, cached fixture builders,
and output normalisation (rounded doubles) so results hash identically to the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.columns import r6
from ..sources import tables
from .sql_fixtures import (  # noqa: F401  (re-exported parameters)
    DISCOUNT_RATE,
    HORIZON_DAYS,
    LOOKBACK_DAYS,
    MARGIN_DATES,
    REVENUE_DATES,
)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(r6(f.name, digits).alias(f.name))
        else:
            cols.append(df[f.name])
    return df.select(*cols)


def fx_orders(spark: SparkSession, sf: str) -> DataFrame:
    return tables.orders_fixture(spark, sf)


def fx_customers(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    return tables.customers_fixture(spark, sf, orders)


def fx_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return tables.transactions_fixture(spark, sf)


def fx_raw(spark: SparkSession, sf: str) -> DataFrame:
    return tables.raw_lines_fixture(spark, sf)
