"""Registered queries: sources, contract/quality (A1-A3, B1-B17), integrity
(B18-B19), temporal split (E1-E2) and preprocessing (F1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import hash_index
from ..operators import contract as ct
from ..operators import integrity as ig
from ..operators import preprocess as pp
from ..operators import snapshots_margin as sm
from ..operators import snapshots_revenue as sr
from ..operators import split as sp
from ..session import ensure_checkpoint_dir
from ..sources import raw as rawsrc
from ..sources import sinks
from ..sources.tables import read_table
from . import sql_fixtures as S
from .common import (
    DISCOUNT_RATE, HORIZON_DAYS, LOOKBACK_DAYS, MARGIN_DATES, REVENUE_DATES,
    fx_customers, fx_orders, fx_raw, fx_transactions, round_doubles,
)

GATE_DATES = ["1995-06-01", *REVENUE_DATES]
SPLIT = dict(selection="1998-06-30", calibration="1999-06-30", test="2000-06-30")


def _canonical(spark, sf):
    return ct.canonicalize(fx_raw(spark, sf))


def source_load_counts(spark, sf):
    """A1: the raw lines written as one CSV folder per source, loaded again by header."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/valuelens/raw-{uuid.uuid4().hex}"
    raw = fx_raw(spark, sf)
    names = ("early", "late")
    for name in names:
        raw.where(F.col("source_sheet") == name).drop("source_sheet").write.option("header", "true").csv(f"{base}/{name}")
    return ct.rows_per_source(rawsrc.load_sources(spark, {name: f"{base}/{name}" for name in names}))


def canonical_transactions(spark, sf):
    return round_doubles(_canonical(spark, sf))


def canonical_roundtrip(spark, sf):
    """A3 + A2: write canonical rows as gzip CSV under the shared folder, read back typed."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/valuelens/canonical-{uuid.uuid4().hex}"
    sinks.write_canonical(_canonical(spark, sf), path, fmt="csv")
    return round_doubles(rawsrc.read_canonical(spark, path, fmt="csv"))


def quality_report(spark, sf):
    return ct.quality_report(fx_raw(spark, sf))


def quality_audit(spark, sf):
    return ct.quality_audit(quality_report(spark, sf), REVENUE_DATES, LOOKBACK_DAYS)


def dedup_transactions(spark, sf):
    raw = fx_raw(spark, sf)
    valid = ct.canonicalize(raw, deduplicate=False)
    before = valid.groupBy("source_sheet").agg(F.count(F.lit(1)).cast("bigint").alias("valid_rows"))
    after = valid.dropDuplicates(ct.CANONICAL_COLUMNS).groupBy("source_sheet") \
        .agg(F.count(F.lit(1)).cast("bigint").alias("distinct_rows"))
    return before.join(after, "source_sheet", "inner") \
        .withColumn("removed_duplicates", F.col("valid_rows") - F.col("distinct_rows"))


def lookback_gate(spark, sf):
    return ct.lookback_coverage(fx_transactions(spark, sf), GATE_DATES, LOOKBACK_DAYS)


def _margin(spark, sf, dates=None):
    return round_doubles(sm.margin_snapshots(fx_customers(spark, sf, fx_orders(spark, sf)), fx_orders(spark, sf), dates or MARGIN_DATES,
                                             LOOKBACK_DAYS, HORIZON_DAYS, DISCOUNT_RATE))


def _revenue(spark, sf, lookback=LOOKBACK_DAYS):
    return round_doubles(sr.revenue_snapshots(fx_transactions(spark, sf), REVENUE_DATES, lookback, HORIZON_DAYS))


def snapshot_checks_margin(spark, sf):
    return ct.snapshot_checks(_margin(spark, sf), MARGIN_DATES)


def snapshot_checks_revenue(spark, sf):
    return ct.snapshot_checks(_revenue(spark, sf), REVENUE_DATES, binary_col="future_active_180d")


def key_uniqueness(spark, sf):
    c, o = fx_customers(spark, sf, fx_orders(spark, sf)), fx_orders(spark, sf)
    f = sm.margin_features(c, o, MARGIN_DATES, LOOKBACK_DAYS)
    lab = sm.margin_labels(c, o, MARGIN_DATES, HORIZON_DAYS, DISCOUNT_RATE)
    keys = ["customer_id", "snapshot_date"]
    return ct.key_uniqueness(f, keys, "features").unionByName(ct.key_uniqueness(lab, keys, "labels"))


def fingerprint_margin(spark, sf):
    return ig.fingerprint(_margin(spark, sf))


def fingerprint_revenue(spark, sf):
    return ig.fingerprint(_revenue(spark, sf))


def table_diff(spark, sf):
    return ig.table_diff(_revenue(spark, sf, 365), _revenue(spark, sf, 300), ["customer_id", "snapshot_date"])


def public_columns(spark, sf):
    cust = fx_customers(spark, sf)
    bal = fx_customers(spark, sf).select("customer_id").join(
        _read(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"),
                                             F.col("c_acctbal").alias("_account_balance")), "customer_id")
    return ct.public_columns(cust.join(bal, "customer_id", "left"))


def _read(spark, sf, name):
    return read_table(spark, sf, name)


def _roles(spark, sf):
    return sp.with_role(_margin(spark, sf), **SPLIT)


def temporal_split(spark, sf):
    return sp.split_summary(_roles(spark, sf))


def development_set(spark, sf):
    return sp.part(_roles(spark, sf), "train", "selection").select("customer_id", "snapshot_date", "role")


#: One value in NULL_SHARE is taken out; the LATE columns lose values in the test part only.
NULL_SHARE = 11
LATE = (sm.MARGIN_NUMERIC[0], sm.MARGIN_NUMERIC[-1])


def preprocess_encode(spark, sf):
    """F1 with nulls put in by a hash: in every column of the test part, in all but the LATE ones of the fit part."""
    roles = _roles(spark, sf)
    for c in [*sm.MARGIN_CATEGORICAL, *sm.MARGIN_NUMERIC]:
        gone = hash_index(F.lit(c), "customer_id", "snapshot_date") % NULL_SHARE == 0
        gone = gone & (F.col("role") == "test") if c in LATE else gone
        roles = roles.withColumn(c, F.when(~gone, F.col(c)))
    fit = sp.part(roles, "train", "selection")
    test = sp.part(roles, "test")
    return round_doubles(pp.preprocess(fit, test, sm.MARGIN_CATEGORICAL, sm.MARGIN_NUMERIC))


QUERIES = {
    "source_load_counts": source_load_counts,
    "canonical_transactions": canonical_transactions,
    "canonical_roundtrip": canonical_roundtrip,
    "quality_report": quality_report,
    "quality_audit": quality_audit,
    "dedup_transactions": dedup_transactions,
    "lookback_gate": lookback_gate,
    "snapshot_checks_margin": snapshot_checks_margin,
    "snapshot_checks_revenue": snapshot_checks_revenue,
    "key_uniqueness": key_uniqueness,
    "fingerprint_margin": fingerprint_margin,
    "fingerprint_revenue": fingerprint_revenue,
    "table_diff": table_diff,
    "public_columns": public_columns,
    "temporal_split": temporal_split,
    "development_set": development_set,
    "preprocess_encode": preprocess_encode,
}

# ---------------------------------------------------------------- oracle SQL

_DATE = """COALESCE(TRY_CAST("InvoiceDate" AS TIMESTAMP), TRY_STRPTIME("InvoiceDate", ['%m/%d/%Y %H:%M', '%Y/%m/%d']))"""

_CANON = r"""c_coerced AS (
  SELECT regexp_replace("Invoice", '^\s+|\s+$', '', 'g') AS invoice_id,
         regexp_replace("StockCode", '^\s+|\s+$', '', 'g') AS stock_code,
         TRY_CAST("Quantity" AS DOUBLE) AS quantity,
         {_DATE} AS invoice_date,
         TRY_CAST("Price" AS DOUBLE) AS unit_price,
         TRY_CAST("Customer ID" AS DOUBLE) AS customer_number,
         regexp_replace("Country", '^\s+|\s+$', '', 'g') AS country,
         source_sheet
  FROM fx_raw),
c_valid AS (
  SELECT invoice_id, stock_code, quantity, invoice_date, unit_price,
         CAST(CAST(round_even(customer_number, 0) AS BIGINT) AS VARCHAR) AS customer_id, country,
         upper(invoice_id) LIKE 'C%' OR quantity < 0 AS is_cancellation,
         CASE WHEN upper(invoice_id) LIKE 'C%' OR quantity < 0 THEN -(abs(quantity) * unit_price)
              ELSE abs(quantity) * unit_price END AS signed_revenue,
         source_sheet
  FROM c_coerced
  WHERE invoice_id IS NOT NULL AND stock_code IS NOT NULL AND invoice_date IS NOT NULL
    AND customer_number IS NOT NULL AND country IS NOT NULL AND quantity IS NOT NULL
    AND unit_price IS NOT NULL AND quantity <> 0 AND unit_price > 0),
c_canon AS (SELECT DISTINCT * FROM c_valid)""".replace("{_DATE}", _DATE)

_QUALITY = """q_report AS (
  SELECT s.*, c.*, s.source_rows - c.usable_rows AS excluded_rows FROM
  (SELECT count(*) AS source_rows,
          CAST(count_if("Customer ID" IS NULL) AS BIGINT) AS missing_customer_rows,
          CAST(count_if({_DATE} IS NULL) AS BIGINT) AS missing_invoice_date_rows,
          CAST(count_if({_DATE} IS NULL AND "InvoiceDate" IS NOT NULL) AS BIGINT) AS unread_invoice_date_rows,
          CAST(count_if(COALESCE(TRY_CAST("Price" AS DOUBLE), 0) <= 0) AS BIGINT) AS nonpositive_price_rows,
          CAST(count_if(COALESCE(TRY_CAST("Quantity" AS DOUBLE), 0) = 0) AS BIGINT) AS zero_quantity_rows,
          count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_raw) d) AS exact_duplicate_rows
   FROM fx_raw) s,
  (SELECT count(*) AS usable_rows, CAST(count_if(is_cancellation) AS BIGINT) AS cancellation_rows,
          count(DISTINCT customer_id) AS customers, count(DISTINCT invoice_id) AS invoices,
          min(invoice_date) AS date_min, max(invoice_date) AS date_max, count(DISTINCT country) AS countries
   FROM c_canon) c)""".replace("{_DATE}", _DATE)

_RAW = [S.FX_RAW, _CANON]
_CANON_DBL = ["quantity", "unit_price", "signed_revenue"]


def _kind_text(name, kind):
    if kind == "double":
        return (f"CAST(CAST(floor({name}) AS BIGINT) AS VARCHAR) || ':' || "
                f"CAST(CAST(round(({name} - floor({name})) * 1000000000.0::DOUBLE) AS BIGINT) AS VARCHAR)")
    if kind == "date":
        return f"strftime({name}, '%Y-%m-%d')"
    return f"CAST({name} AS VARCHAR)"


def _fingerprint_sql(ctes, table, cols, doubles, dates=("snapshot_date",)):
    parts = []
    for c in cols:
        kind = "double" if c in doubles else "date" if c in dates else "other"
        parts.append(f"COALESCE({_kind_text(c, kind)}, '\\N')")
    body = f"""SELECT rows, substr(md5(concat_ws(':', CAST(COALESCE(x, 0) AS VARCHAR), CAST(COALESCE(s, 0) AS VARCHAR), CAST(rows AS VARCHAR))), 1, 16) AS fingerprint
FROM (SELECT count(*) AS rows, bit_xor(h) AS x, sum(CAST(h AS HUGEINT)) AS s
      FROM (SELECT ('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT AS h FROM {table}) a) b"""
    return S.with_ctes(*ctes, body=body)


_M_ALL = S.MARGIN_FEATURE_COLS + S.MARGIN_LABEL_COLS
_R_ALL = S.REVENUE_FEATURE_COLS + S.REVENUE_LABEL_COLS
_R_NAMES = ["params", "event", "row", "elig", "latest", "snap"]


def _rounded_table(name, src, doubles):
    rep = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles)
    return f"{name} AS (SELECT * REPLACE ({rep}) FROM {src})"


def _snapshot_checks_sql(ctes, table, cols, doubles, dates, binary=None):
    nulls = " + ".join(f"count_if({c} IS NULL)" for c in cols)
    nonfinite = " + ".join(f"count_if(isnan({c}) OR isinf({c}))" for c in doubles)
    dl = ", ".join(f"'{d}'" for d in dates)
    extra = f", CAST(count_if({binary} NOT IN (0, 1)) AS BIGINT) AS nonbinary_active_rows" if binary else ""
    return S.with_ctes(*ctes, body=f"""SELECT count(*) AS rows,
  count(*) - count(DISTINCT (customer_id, snapshot_date)) AS duplicate_keys,
  CAST({nulls} AS BIGINT) AS null_values,
  count(DISTINCT snapshot_date) AS distinct_dates,
  CAST(count_if(strftime(snapshot_date, '%Y-%m-%d') NOT IN ({dl})) AS BIGINT) AS unexpected_date_rows,
  CAST({nonfinite} AS BIGINT) AS nonfinite_values{extra},
  {len(dates)} - count(DISTINCT snapshot_date) AS missing_dates
FROM {table}""")


def _table_diff_sql():
    a = S.revenue_snapshot_ctes()
    b = S.renamed(S.revenue_snapshot_ctes(L=300), "r_", "r2_", _R_NAMES)
    ra = _rounded_table("d_left", "r_snap", S.REVENUE_DOUBLE_COLS)
    rb = _rounded_table("d_right", "r2_snap", S.REVENUE_DOUBLE_COLS)
    numeric = [c for c in _R_ALL if c not in ("customer_id", "snapshot_date", "country")]
    flags = []
    for c in [c for c in _R_ALL if c not in ("customer_id", "snapshot_date")]:
        if c in numeric:
            same = (f"COALESCE((l.{c} IS NULL AND r.{c} IS NULL) OR abs(CAST(l.{c} AS DOUBLE) - CAST(r.{c} AS DOUBLE)) "
                    f"<= 1e-12::DOUBLE + 1e-12::DOUBLE * abs(CAST(r.{c} AS DOUBLE)), FALSE)")
        else:
            same = f"l.{c} IS NOT DISTINCT FROM r.{c}"
        flags.append(f"CASE WHEN NOT ({same}) THEN '{c}' END")
    changed = f"concat_ws(',', {', '.join(flags)})"
    body = f"""SELECT * FROM (
  SELECT COALESCE(l.customer_id, r.customer_id) AS customer_id, COALESCE(l.snapshot_date, r.snapshot_date) AS snapshot_date,
         CASE WHEN r.customer_id IS NULL THEN 'left_only' WHEN l.customer_id IS NULL THEN 'right_only'
              WHEN {changed} <> '' THEN 'changed' END AS status,
         CASE WHEN l.customer_id IS NOT NULL AND r.customer_id IS NOT NULL THEN {changed} ELSE '' END AS changed_columns
  FROM d_left l FULL OUTER JOIN d_right r
    ON l.customer_id IS NOT DISTINCT FROM r.customer_id AND l.snapshot_date IS NOT DISTINCT FROM r.snapshot_date) z
WHERE status IS NOT NULL"""
    return S.with_ctes(*a, *b, ra, rb, body=body)


def _role_case():
    return (f"CASE WHEN snapshot_date < DATE '{SPLIT['selection']}' THEN 'train' "
            f"WHEN snapshot_date = DATE '{SPLIT['selection']}' THEN 'selection' "
            f"WHEN snapshot_date = DATE '{SPLIT['calibration']}' THEN 'calibration' "
            f"WHEN snapshot_date = DATE '{SPLIT['test']}' THEN 'test' END")


def _preprocess_sql():
    m = S.margin_snapshot_ctes()
    holes = ", ".join(
        f"CASE WHEN ('0x' || substr(md5(concat_ws('|', '{c}', customer_id::VARCHAR, snapshot_date::VARCHAR)), 1, 15))::BIGINT % {NULL_SHARE} = 0"
        f"{' AND role = ' + chr(39) + 'test' + chr(39) if c in LATE else ''} THEN NULL ELSE {c} END AS {c}"
        for c in [*sm.MARGIN_CATEGORICAL, *sm.MARGIN_NUMERIC])
    roles = f"pr_roles AS (SELECT * REPLACE ({holes}) FROM (SELECT *, {_role_case()} AS role FROM m_snap) z)"
    fills = ", ".join([f"(SELECT {c} FROM pr_fit WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}" for c in sm.MARGIN_CATEGORICAL]
                      + [f"(SELECT quantile_cont({c}::DOUBLE, 0.5) FROM pr_fit) AS {c}" for c in sm.MARGIN_NUMERIC])
    codes = ["pr_fit AS (SELECT * FROM pr_roles WHERE role IN ('train', 'selection'))", f"pr_fill AS (SELECT {fills})"]
    for c in sm.MARGIN_CATEGORICAL:
        codes.append(f"""pr_{c} AS (SELECT {c} AS v, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS code
  FROM (SELECT DISTINCT {c} FROM pr_roles WHERE role IN ('train', 'selection') AND {c} IS NOT NULL) d)""")
    sel = ["t.customer_id", "t.snapshot_date"]
    joins = []
    for c in sm.MARGIN_CATEGORICAL:
        sel.append(f"COALESCE(j_{c}.code, -1.0::DOUBLE) AS {c}")
        joins.append(f"LEFT JOIN pr_{c} j_{c} ON j_{c}.v = COALESCE(t.{c}, pr_fill.{c})")
    sel += [f"round(COALESCE(CAST(t.{c} AS DOUBLE), pr_fill.{c}), 6) + 0.0 AS {c}" for c in sm.MARGIN_NUMERIC]
    body = f"SELECT {', '.join(sel)} FROM (SELECT * FROM pr_roles WHERE role = 'test') t CROSS JOIN pr_fill {' '.join(joins)}"
    return S.with_ctes(*m, roles, *codes, body=body)


def _sql_all():
    out = {}
    out["source_load_counts"] = S.with_ctes(S.FX_TX, *_RAW, body="SELECT source_sheet, count(*) AS rows FROM fx_raw GROUP BY source_sheet")
    out["canonical_transactions"] = S.round_cols(S.with_ctes(*_RAW, body="SELECT * FROM c_canon"), _CANON_DBL)
    out["canonical_roundtrip"] = out["canonical_transactions"]
    out["quality_report"] = S.with_ctes(*_RAW, _QUALITY, body="SELECT * FROM q_report")
    dates = ", ".join(f"(DATE '{d}')" for d in REVENUE_DATES)
    out["quality_audit"] = S.with_ctes(*_RAW, _QUALITY, body=f"""SELECT snapshot_date, available_history_days, CAST({LOOKBACK_DAYS} AS BIGINT) AS required_days,
  available_history_days >= {LOOKBACK_DAYS} AS complete, other_invalid_rows_excluded,
  min(available_history_days) OVER () AS minimum_available_days,
  bool_and(available_history_days >= {LOOKBACK_DAYS}) OVER () AS all_snapshots_complete
FROM (SELECT d.snapshot_date, CAST(date_diff('day', CAST(q.date_min AS DATE), d.snapshot_date) AS BIGINT) AS available_history_days,
             CAST(q.excluded_rows - q.missing_customer_rows AS BIGINT) AS other_invalid_rows_excluded
      FROM q_report q, (VALUES {dates}) d(snapshot_date)) z""")
    out["dedup_transactions"] = S.with_ctes(*_RAW, body="""SELECT a.source_sheet, a.valid_rows, b.distinct_rows, a.valid_rows - b.distinct_rows AS removed_duplicates
FROM (SELECT source_sheet, count(*) AS valid_rows FROM c_valid GROUP BY source_sheet) a
JOIN (SELECT source_sheet, count(*) AS distinct_rows FROM c_canon GROUP BY source_sheet) b USING (source_sheet)""")
    gd = ", ".join(f"(DATE '{d}')" for d in GATE_DATES)
    out["lookback_gate"] = S.with_ctes(S.FX_TX, body=f"""SELECT d.snapshot_date,
  CAST(date_diff('day', CAST(s.start AS DATE), d.snapshot_date) AS BIGINT) AS available_days,
  CAST(d.snapshot_date AS TIMESTAMP) >= s.start + INTERVAL {LOOKBACK_DAYS} DAY AS complete
FROM (SELECT min(invoice_date) AS start FROM fx_tx) s, (VALUES {gd}) d(snapshot_date)""")
    m = S.margin_snapshot_ctes()
    r = S.revenue_snapshot_ctes()
    mr = _rounded_table("m_round", "m_snap", S.MARGIN_DOUBLE_COLS)
    rr = _rounded_table("r_round", "r_snap", S.REVENUE_DOUBLE_COLS)
    out["snapshot_checks_margin"] = _snapshot_checks_sql([*m, mr], "m_round", _M_ALL, S.MARGIN_DOUBLE_COLS, MARGIN_DATES)
    out["snapshot_checks_revenue"] = _snapshot_checks_sql([*r, rr], "r_round", _R_ALL, S.REVENUE_DOUBLE_COLS, REVENUE_DATES,
                                                          "future_active_180d")
    out["key_uniqueness"] = S.with_ctes(*m, body="""SELECT 'features' AS side, count(*) AS rows, count(DISTINCT (customer_id, snapshot_date)) AS distinct_keys FROM m_snap
UNION ALL SELECT 'labels' AS side, count(*) AS rows, count(DISTINCT (customer_id, snapshot_date)) AS distinct_keys
FROM (SELECT customer_id, snapshot_date FROM fx_cust, m_params WHERE acquisition_date <= snapshot_date) z""")
    out["fingerprint_margin"] = _fingerprint_sql([*m, mr], "m_round", _M_ALL, S.MARGIN_DOUBLE_COLS)
    out["fingerprint_revenue"] = _fingerprint_sql([*r, rr], "r_round", _R_ALL, S.REVENUE_DOUBLE_COLS)
    out["table_diff"] = _table_diff_sql()
    out["public_columns"] = S.with_ctes(S.FX_ORD, S.FX_CUST, body="SELECT * FROM fx_cust")
    out["temporal_split"] = S.with_ctes(*m, body=f"""SELECT role, count(*) AS rows, min(snapshot_date) AS min_date, max(snapshot_date) AS max_date
FROM (SELECT *, {_role_case()} AS role FROM m_snap) z WHERE role IS NOT NULL GROUP BY role""")
    out["development_set"] = S.with_ctes(*m, body=f"""SELECT customer_id, snapshot_date, role
FROM (SELECT *, {_role_case()} AS role FROM m_snap) z WHERE role IN ('train', 'selection')""")
    out["preprocess_encode"] = _preprocess_sql()
    return out


SQL = _sql_all()
