"""DuckDB SQL for the fixture mappings, used as the correctness oracle.

Each constant is a list of CTE definitions (``name AS (...)``); ``with_ctes``
joins the ones a query needs in front of its body.  Views ``region nation
customer supplier part orders lineitem`` are registered by the checker.
"""

from __future__ import annotations

# Fixed parameters of the registered queries (the reference's configuration shape,
# moved onto the supplied tables' date range).
MARGIN_DATES = ["1997-06-30", "1998-06-30", "1999-06-30", "2000-06-30"]
REVENUE_DATES = ["1997-07-01", "1998-07-01", "1999-07-01", "2000-07-01"]
LOOKBACK_DAYS = 365
HORIZON_DAYS = 180
DISCOUNT_RATE = 0.10

FX_ORD = """fx_ord AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id,
         CAST(o.o_orderdate AS DATE) AS order_date, l.category,
         o.o_orderpriority AS order_channel,
         CAST(round(l.net, 2) AS DOUBLE) AS net_revenue,
         CAST(round(l.net - l.cost, 2) AS DOUBLE) AS contribution_margin,
         l.disc AS discount_ratio, l.returned
  FROM orders o
  JOIN (SELECT l_orderkey, min(p_type) AS category,
               sum(CAST(l_extendedprice * (1.0::DOUBLE - l_discount) AS DECIMAL(18,4))) AS net,
               sum(CAST(0.8::DOUBLE * p_retailprice * l_quantity AS DECIMAL(18,4))) AS cost,
               max(l_discount) AS disc,
               max(CAST(l_returnflag = 'R' AS INTEGER)) AS returned
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY l_orderkey) l
    ON o.o_orderkey = l.l_orderkey)"""

FX_CUST = """fx_cust AS (
  SELECT c.c_custkey AS customer_id, a.acquisition_date,
         c.c_mktsegment AS acquisition_channel, r.r_name AS region
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT customer_id, min(order_date) AS acquisition_date
             FROM fx_ord GROUP BY customer_id) a ON a.customer_id = c.c_custkey)"""

FX_TX = """fx_tx AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS invoice_id,
         CAST(l.l_partkey AS VARCHAR) AS stock_code,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS DOUBLE) AS quantity,
         CAST(o.o_orderdate AS TIMESTAMP) AS invoice_date,
         CAST(p.p_retailprice AS DOUBLE) AS unit_price,
         CAST(o.o_custkey AS VARCHAR) AS customer_id,
         n.n_name AS country,
         l.l_returnflag = 'R' AS is_cancellation,
         CASE WHEN l.l_returnflag = 'R' THEN -(abs(l.l_quantity) * p.p_retailprice)
              ELSE abs(l.l_quantity) * p.p_retailprice END AS signed_revenue,
         CASE WHEN o.o_orderdate < TIMESTAMP '1998-01-01' THEN 'early' ELSE 'late' END AS source_sheet
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

FX_RAW = """fx_raw_base AS (
  SELECT l.l_orderkey AS k,
         CASE WHEN l.l_orderkey % 41 = 0 THEN '  ' || CAST(l.l_orderkey AS VARCHAR) || ' '
              WHEN l.l_orderkey % 43 = 0 THEN 'C' || CAST(l.l_orderkey AS VARCHAR)
              ELSE CAST(l.l_orderkey AS VARCHAR) END AS "Invoice",
         CAST(l.l_partkey AS VARCHAR) AS "StockCode",
         'part ' || CAST(l.l_partkey AS VARCHAR) AS "Description",
         CASE WHEN l.l_orderkey % 31 = 0 THEN 'abc'
              ELSE CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS VARCHAR) END AS "Quantity",
         CASE WHEN l.l_orderkey % 37 = 0 THEN 'not a date' WHEN l.l_orderkey % 3 = 0 THEN strftime(o.o_orderdate, '%-m/%-d/%Y %-H:%M')
              WHEN l.l_orderkey % 7 = 0 THEN strftime(o.o_orderdate, '%Y/%-m/%-d')
              ELSE strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') END AS "InvoiceDate",
         CASE WHEN l.l_orderkey % 29 = 0 THEN '0' ELSE CAST(p.p_retailprice AS VARCHAR) END AS "Price",
         CASE WHEN l.l_orderkey % 23 = 0 THEN NULL ELSE CAST(o.o_custkey AS VARCHAR) || '.0' END AS "Customer ID",
         n.n_name AS "Country",
         CASE WHEN o.o_orderdate < TIMESTAMP '1998-01-01' THEN 'early' ELSE 'late' END AS source_sheet
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey),
fx_raw AS (
  SELECT * EXCLUDE (k) FROM fx_raw_base
  UNION ALL SELECT * EXCLUDE (k) FROM fx_raw_base WHERE k % 50 = 0
  UNION ALL SELECT * EXCLUDE (k, source_sheet),
                   CASE WHEN source_sheet = 'early' THEN 'late' ELSE 'early' END AS source_sheet
            FROM fx_raw_base WHERE k % 53 = 0)"""


def values_dates(dates: list[str], cast: str = "DATE") -> str:
    rows = ", ".join(f"('{d}')" for d in dates)
    return f"SELECT CAST(d AS {cast}) AS snapshot_date FROM (VALUES {rows}) v(d)"


def with_ctes(*ctes: str, body: str) -> str:
    seen, uniq = set(), []
    for c in ctes:
        if c not in seen:
            seen.add(c)
            uniq.append(c)
    return "WITH " + ",\n".join(uniq) + "\n" + body


def renamed(ctes: list[str], prefix: str, new_prefix: str, names: list[str]) -> list[str]:
    """Copy of CTE definitions with the given CTE names re-prefixed (shared fixtures kept)."""
    out = []
    for c in ctes:
        for n in names:
            c = c.replace(prefix + n, new_prefix + n)
        out.append(c)
    return out


def round_cols(sql: str, cols: list[str], digits: int = 6) -> str:
    """Wrap ``sql`` so that the listed double columns are rounded like ``r6``."""
    if not cols:
        return sql
    rep = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS q"


# The output columns of both snapshot tables.
MARGIN_FEATURE_COLS = [
    "customer_id", "snapshot_date", "acquisition_channel", "region", "tenure_days", "recency_days",
    "orders_30d", "orders_90d", "orders_180d", "orders_365d", "revenue_90d", "revenue_180d",
    "revenue_365d", "margin_90d", "margin_previous_90d", "margin_180d", "margin_365d",
    "average_order_value_365d", "average_discount_365d", "return_rate_365d",
    "category_diversity_365d", "active_months_365d", "margin_momentum_90d", "recent_order_share",
]
MARGIN_LABEL_COLS = ["future_orders_180d", "future_discounted_margin_180d", "future_active_180d"]
MARGIN_DOUBLE_COLS = [
    "revenue_90d", "revenue_180d", "revenue_365d", "margin_90d", "margin_previous_90d",
    "margin_180d", "margin_365d", "average_order_value_365d", "average_discount_365d",
    "return_rate_365d", "margin_momentum_90d", "recent_order_share", "future_discounted_margin_180d",
]
REVENUE_FEATURE_COLS = [
    "customer_id", "snapshot_date", "country", "observed_tenure_days", "recency_days",
    "orders_30d", "orders_90d", "orders_180d", "orders_365d", "net_revenue_90d",
    "net_revenue_previous_90d", "net_revenue_180d", "net_revenue_365d", "average_order_value_365d",
    "return_value_ratio_365d", "product_diversity_365d", "active_months_365d",
    "revenue_momentum_90d", "recent_order_share",
]
REVENUE_LABEL_COLS = ["future_net_revenue_180d", "future_active_180d"]
REVENUE_DOUBLE_COLS = [
    "net_revenue_90d", "net_revenue_previous_90d", "net_revenue_180d", "net_revenue_365d",
    "average_order_value_365d", "return_value_ratio_365d", "revenue_momentum_90d",
    "recent_order_share", "future_net_revenue_180d",
]


def _windowed(spec: list[tuple[str, str, str, str]], kind: str) -> str:
    """Select items ``name``: an aggregate over the events that a condition lets through, 0 for none."""
    return ",\n    ".join(f"CAST(COALESCE({agg} FILTER ({cond}), 0) AS {kind_ or kind}) AS {name}" for name, agg, cond, kind_ in spec)


def margin_snapshot_ctes(dates=None, L=LOOKBACK_DAYS, H=HORIZON_DAYS, r=DISCOUNT_RATE) -> list[str]:
    """

    Each order near a snapshot is one event with its age in days (today 0, the future
    below 0); a snapshot row is one aggregate over its customer's events.
    """
    dates = dates or MARGIN_DATES
    events = f"""m_event AS (
  SELECT who.customer_id, p.snapshot_date, who.acquisition_channel, who.region, who.acquisition_date,
    o.* EXCLUDE (customer_id, order_date), o.order_date AS day, p.snapshot_date - o.order_date AS age
  FROM m_params p, fx_cust who LEFT JOIN fx_ord o
    ON o.customer_id = who.customer_id AND p.snapshot_date - o.order_date BETWEEN {-int(H)} AND {int(L) - 1}
  WHERE who.acquisition_date <= p.snapshot_date)"""
    past = lambda lo, hi: f"WHERE age BETWEEN {lo} AND {hi - 1}"
    counts = [(f"orders_{w}d", "count(DISTINCT order_id)", past(0, w), "") for w in (30, 90, 180)]
    counts += [(f"{name}_365d", f"count(DISTINCT {what})", past(0, int(L)), "") for name, what in
               (("orders", "order_id"), ("category_diversity", "category"), ("active_months", "date_trunc('month', day)"))]
    sums = [(f"{name}_{w}d", f"sum({what})", past(lo, hi), "") for name, what in (("revenue", "net_revenue"), ("margin", "contribution_margin"))
            for w, lo, hi in ((90, 0, 90), (180, 0, 180), (365, 0, int(L)))]
    sums += [("margin_previous_90d", "sum(contribution_margin)", past(90, 180), "")]
    sums += [(f"{name}_365d", f"avg({what})", past(0, int(L)), "") for name, what in
             (("average_order_value", "net_revenue"), ("average_discount", "discount_ratio"), ("return_rate", "returned"))]
    sums += [("future_discounted_margin_180d", f"sum(contribution_margin / (1 - {float(r)!r}::DOUBLE * age / 365.0::DOUBLE))", "WHERE age < 0", "")]
    counts += [("future_orders_180d", "count(DISTINCT order_id)", "WHERE age < 0", "")]
    rows = f"""m_row AS (
  SELECT customer_id, snapshot_date, any_value(acquisition_channel) AS acquisition_channel, any_value(region) AS region,
    CAST(snapshot_date - any_value(acquisition_date) AS BIGINT) AS tenure_days,
    CAST(COALESCE(min(age) FILTER (WHERE age >= 0), {int(L) + 1}) AS BIGINT) AS recency_days,
    {_windowed(counts, 'BIGINT')},
    {_windowed(sums, 'DOUBLE')}
  FROM m_event GROUP BY customer_id, snapshot_date)"""
    derived = """m_full AS (
  SELECT *, margin_90d - margin_previous_90d AS margin_momentum_90d,
    COALESCE(orders_90d / NULLIF(orders_365d, 0)::DOUBLE, 0) AS recent_order_share,
    CAST(future_orders_180d > 0 AS INTEGER) AS future_active_180d FROM m_row)"""
    snap = f"m_snap AS (SELECT {', '.join(MARGIN_FEATURE_COLS + MARGIN_LABEL_COLS)} FROM m_full)"
    return [FX_ORD, FX_CUST, f"m_params AS ({values_dates(dates)})", events, rows, derived, snap]


def revenue_snapshot_ctes(dates=None, L=LOOKBACK_DAYS, H=HORIZON_DAYS) -> list[str]:
    """

    Every line before a snapshot's horizon ends is one event, marked as past, recent (in
    the lookback) or future, and as bought; one aggregate per customer and snapshot.
    """
    dates = dates or REVENUE_DATES
    events = f"""r_event AS (
  SELECT t.*, p.snapshot_date, t.invoice_date < p.snapshot_date AS past, t.invoice_date >= p.snapshot_date AS future,
    t.invoice_date < p.snapshot_date AND t.invoice_date >= p.snapshot_date - to_days({int(L)}) AS recent,
    t.signed_revenue > 0 AND NOT t.is_cancellation AS bought,
    date_diff('day', t.invoice_date::DATE, p.snapshot_date::DATE) AS age
  FROM fx_tx t JOIN r_params p ON t.invoice_date < p.snapshot_date + to_days({int(H)}))"""
    span = lambda lo, hi, more="": f"WHERE recent AND age > {lo} AND age <= {hi}{more}"
    first = "WHERE recent AND age <= "
    counts = [(f"orders_{w}d", "count(DISTINCT invoice_id)", f"{first}{w} AND bought", "") for w in (30, 90, 180, 365)]
    counts += [(f"{name}_365d", f"count(DISTINCT {what})", f"{first}365 AND bought", "") for name, what in
               (("product_diversity", "stock_code"), ("active_months", "strftime(invoice_date, '%Y%m')"))]
    sums = [(f"net_revenue_{w}d", "sum(signed_revenue)", f"{first}{w}", "") for w in (90, 180, 365)]
    sums += [("net_revenue_previous_90d", "sum(signed_revenue)", span(90, 180), ""),
             ("returned_value", "-sum(signed_revenue)", f"{first}365 AND is_cancellation", ""),
             ("bought_value", "sum(signed_revenue)", f"{first}365 AND bought", ""),
             ("future_net_revenue_180d", "sum(signed_revenue)", "WHERE future", "")]
    rows = f"""r_row AS (
  SELECT customer_id, snapshot_date, min(invoice_date) FILTER (WHERE past AND bought) AS first_purchase_date,
    max(struct_pack(d := invoice_date, i := invoice_id, s := stock_code, c := country)) FILTER (WHERE past) AS newest,
    CAST(COALESCE(min(age) FILTER (WHERE recent AND bought), {int(L) + 1}) AS BIGINT) AS recency_days,
    CAST(count(*) FILTER (WHERE future) > 0 AS INTEGER) AS future_active_180d,
    {_windowed(counts, 'BIGINT')},
    {_windowed(sums, 'DOUBLE')}
  FROM r_event GROUP BY customer_id, snapshot_date
  HAVING count(*) FILTER (WHERE past AND bought) > 0)"""
    elig = "r_elig AS (SELECT snapshot_date, customer_id, first_purchase_date FROM r_row)"
    latest = "r_latest AS (SELECT snapshot_date, customer_id, newest.c AS country FROM r_row)"
    snap = f"""r_snap AS (
  SELECT {', '.join(REVENUE_FEATURE_COLS + REVENUE_LABEL_COLS)} FROM (
    SELECT * REPLACE (CAST(snapshot_date AS DATE) AS snapshot_date), newest.c AS country,
      CAST(date_diff('day', first_purchase_date::DATE, snapshot_date::DATE) AS BIGINT) AS observed_tenure_days,
      COALESCE(net_revenue_365d / NULLIF(orders_365d, 0), 0)::DOUBLE AS average_order_value_365d,
      COALESCE(returned_value / NULLIF(bought_value, 0), 0)::DOUBLE AS return_value_ratio_365d,
      (net_revenue_90d - net_revenue_previous_90d) / (1 + abs(net_revenue_90d) + abs(net_revenue_previous_90d))::DOUBLE AS revenue_momentum_90d,
      COALESCE(orders_90d / NULLIF(orders_365d, 0)::DOUBLE, 0) AS recent_order_share
    FROM r_row) z)"""
    return [FX_TX, f"r_params AS ({values_dates(dates, 'TIMESTAMP')})", events, rows, elig, latest, snap]
