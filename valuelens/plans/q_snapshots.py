"""Registered queries: as-of snapshots (margin C0-C19, revenue D0-D19)."""

from __future__ import annotations

from ..operators import snapshots_margin as sm
from ..operators import snapshots_revenue as sr
from . import sql_fixtures as S
from .common import (
    DISCOUNT_RATE, HORIZON_DAYS, LOOKBACK_DAYS, MARGIN_DATES, REVENUE_DATES,
    fx_customers, fx_orders, fx_transactions, round_doubles,
)


def margin_snapshots(spark, sf):
    orders = fx_orders(spark, sf)
    customers = fx_customers(spark, sf, orders)
    return round_doubles(sm.margin_snapshots(customers, orders, MARGIN_DATES, LOOKBACK_DAYS,
                                             HORIZON_DAYS, DISCOUNT_RATE))


def margin_features(spark, sf):
    o = fx_orders(spark, sf)
    return round_doubles(sm.margin_features(fx_customers(spark, sf, o), o, MARGIN_DATES, LOOKBACK_DAYS))


def margin_labels(spark, sf):
    o = fx_orders(spark, sf)
    return round_doubles(sm.margin_labels(fx_customers(spark, sf, o), o, MARGIN_DATES, HORIZON_DAYS, DISCOUNT_RATE))


def margin_snapshots_joined(spark, sf):
    o = fx_orders(spark, sf)
    return round_doubles(sm.margin_snapshots_by_join(fx_customers(spark, sf, o), o,
                                                     MARGIN_DATES, LOOKBACK_DAYS, HORIZON_DAYS,
                                                     DISCOUNT_RATE))


def revenue_snapshots(spark, sf):
    return round_doubles(sr.revenue_snapshots(fx_transactions(spark, sf), REVENUE_DATES,
                                              LOOKBACK_DAYS, HORIZON_DAYS))


def revenue_features(spark, sf):
    return round_doubles(sr.revenue_features(fx_transactions(spark, sf), REVENUE_DATES, LOOKBACK_DAYS))


def revenue_labels(spark, sf):
    return round_doubles(sr.revenue_labels(fx_transactions(spark, sf), REVENUE_DATES, HORIZON_DAYS))


def eligible_customers(spark, sf):
    return sr.eligible_customers(fx_transactions(spark, sf), REVENUE_DATES) \
        .select("customer_id", "snapshot_date", "first_purchase_date")


def latest_country(spark, sf):
    return sr.eligible_customers(fx_transactions(spark, sf), REVENUE_DATES) \
        .select("customer_id", "snapshot_date", "country")


def margin_snapshots_sql(spark, sf):
    from ..operators.snapshots_sql import margin_snapshots_sql as build
    o = fx_orders(spark, sf)
    return round_doubles(build(fx_customers(spark, sf, o), o, MARGIN_DATES, LOOKBACK_DAYS, HORIZON_DAYS,
                               DISCOUNT_RATE))


def margin_orders(spark, sf):
    return round_doubles(fx_orders(spark, sf))


def margin_customers(spark, sf):
    return fx_customers(spark, sf)


QUERIES = {
    "margin_orders": margin_orders,
    "margin_customers": margin_customers,
    "margin_snapshots": margin_snapshots,
    "margin_features": margin_features,
    "margin_labels": margin_labels,
    "margin_snapshots_joined": margin_snapshots_joined,
    "margin_snapshots_sql": margin_snapshots_sql,
    "revenue_snapshots": revenue_snapshots,
    "revenue_features": revenue_features,
    "revenue_labels": revenue_labels,
    "eligible_customers": eligible_customers,
    "latest_country": latest_country,
}

_M = S.margin_snapshot_ctes()
_R = S.revenue_snapshot_ctes()
_MF = ", ".join(S.MARGIN_FEATURE_COLS)
_ML = ", ".join(["customer_id", "snapshot_date", *S.MARGIN_LABEL_COLS])
_RF = ", ".join(S.REVENUE_FEATURE_COLS)
_RL = ", ".join(["customer_id", "snapshot_date", *S.REVENUE_LABEL_COLS])


def _rd(sql, cols):
    return S.round_cols(sql, cols)


SQL = {
    "margin_orders": _rd(S.with_ctes(S.FX_ORD, body="SELECT * FROM fx_ord"),
                         ["net_revenue", "contribution_margin", "discount_ratio"]),
    "margin_customers": S.with_ctes(S.FX_ORD, S.FX_CUST, body="SELECT * FROM fx_cust"),
    "margin_snapshots": _rd(S.with_ctes(*_M, body="SELECT * FROM m_snap"), S.MARGIN_DOUBLE_COLS),
    "margin_snapshots_joined": _rd(S.with_ctes(*_M, body="SELECT * FROM m_snap"), S.MARGIN_DOUBLE_COLS),
    "margin_snapshots_sql": _rd(S.with_ctes(*_M, body="SELECT * FROM m_snap"), S.MARGIN_DOUBLE_COLS),
    "margin_features": _rd(S.with_ctes(*_M, body=f"SELECT {_MF} FROM m_snap"),
                           [c for c in S.MARGIN_DOUBLE_COLS if c in S.MARGIN_FEATURE_COLS]),
    "margin_labels": _rd(S.with_ctes(*_M, body=f"SELECT {_ML} FROM m_snap"),
                         ["future_discounted_margin_180d"]),
    "revenue_snapshots": _rd(S.with_ctes(*_R, body="SELECT * FROM r_snap"), S.REVENUE_DOUBLE_COLS),
    "revenue_features": _rd(S.with_ctes(*_R, body=f"SELECT {_RF} FROM r_snap"),
                            [c for c in S.REVENUE_DOUBLE_COLS if c in S.REVENUE_FEATURE_COLS]),
    "revenue_labels": _rd(S.with_ctes(*_R, body=f"SELECT {_RL} FROM r_snap"), ["future_net_revenue_180d"]),
    "eligible_customers": S.with_ctes(*_R, body=(
        "SELECT customer_id, CAST(snapshot_date AS DATE) AS snapshot_date, first_purchase_date FROM r_elig")),
    "latest_country": S.with_ctes(*_R, body=(
        "SELECT e.customer_id, CAST(e.snapshot_date AS DATE) AS snapshot_date, l.country "
        "FROM r_elig e JOIN r_latest l USING (customer_id, snapshot_date)")),
}
