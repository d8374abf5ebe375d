"""DuckDB oracle SQL for the closed-form scored frames and conformal correction."""

from __future__ import annotations

from . import sql_fixtures as S

MARGIN_CAL_DATE, MARGIN_TEST_DATE = "1999-06-30", "2000-06-30"
REVENUE_CAL_DATE, REVENUE_TEST_DATE = "1999-07-01", "2000-07-01"
TARGET_COVERAGE = 0.80


def _trail(value, recent, previous, smooth, clip):
    change = (f"least(greatest(({recent} - {previous}) / (abs({recent}) + abs({previous}) + {smooth}::DOUBLE), "
              f"-{clip}::DOUBLE), {clip}::DOUBLE)")
    return f"{value} * exp(-CAST(recency_days AS DOUBLE) / 220.0::DOUBLE) * (1.0::DOUBLE + {change})"


def score_ctes(path: str = "margin") -> list[str]:
    """CTEs: sc_env (both dates, raw interval), sc_conf (one row), sc_test (calibrated)."""
    if path == "margin":
        snap = S.margin_snapshot_ctes(dates=[MARGIN_CAL_DATE, MARGIN_TEST_DATE])
        src, y, base, trailing = "m_snap", "future_discounted_margin_180d", \
            _trail("margin_180d", "margin_90d", "margin_previous_90d", "10.0", "0.45"), "margin_365d"
        cal, test = MARGIN_CAL_DATE, MARGIN_TEST_DATE
        n = dict(pred="predicted_clv_180d", lo_raw="clv_lower_80_raw", hi_raw="clv_upper_80_raw",
                 lo="clv_lower_80", hi="clv_upper_80", b="baseline_clv_180d")
    else:
        snap = S.revenue_snapshot_ctes(dates=[REVENUE_CAL_DATE, REVENUE_TEST_DATE])
        src, y, base, trailing = "r_snap", "future_net_revenue_180d", \
            _trail("net_revenue_180d", "net_revenue_90d", "net_revenue_previous_90d", "1.0", "0.5"), "net_revenue_365d"
        cal, test = REVENUE_CAL_DATE, REVENUE_TEST_DATE
        n = dict(pred="predicted_revenue_180d", lo_raw="revenue_lower_80_raw", hi_raw="revenue_upper_80_raw",
                 lo="revenue_lower_80", hi="revenue_upper_80", b="baseline_revenue_180d")
    raw = f"""sc_raw AS (
  SELECT *, round({base}, 6) + 0.0 AS {n['b']},
         CAST(orders_365d AS DOUBLE) / (CAST(orders_365d AS DOUBLE) + 1.0::DOUBLE) AS active_probability_180d
  FROM {src})"""
    pred = f"""sc_pred AS (
  SELECT *, round(active_probability_180d * 0.5::DOUBLE * {trailing}, 6) + 0.0 AS {n['pred']} FROM sc_raw)"""
    env = f"""sc_env AS (
  SELECT *, least(0.4::DOUBLE * {n['pred']} - 1.0::DOUBLE, {n['pred']}) AS {n['lo_raw']},
            greatest(1.6::DOUBLE * {n['pred']} + 1.0::DOUBLE, {n['pred']}) AS {n['hi_raw']}
  FROM sc_pred)"""
    cs = f"""sc_cs AS (
  SELECT {y} AS y, {n['lo_raw']} AS lo, {n['hi_raw']} AS hi,
         greatest({n['lo_raw']} - {y}, {y} - {n['hi_raw']}) AS s,
         row_number() OVER (ORDER BY greatest({n['lo_raw']} - {y}, {y} - {n['hi_raw']}), customer_id, snapshot_date) AS rn,
         count(*) OVER () AS n
  FROM sc_env WHERE snapshot_date = DATE '{cal}')"""
    conf = f"""sc_conf AS (
  SELECT {TARGET_COVERAGE}::DOUBLE AS target_coverage,
         greatest(max(s) FILTER (WHERE rn = least(CAST(ceil(CAST(n + 1 AS DOUBLE) * {TARGET_COVERAGE}::DOUBLE) AS BIGINT) + 1, n)), 0.0::DOUBLE) AS correction,
         count(*) AS calibration_rows
  FROM sc_cs)"""
    conf2 = """sc_conf2 AS (
  SELECT c.target_coverage, c.correction, c.calibration_rows,
         avg(CAST(x.y >= x.lo AND x.y <= x.hi AS DOUBLE)) AS raw_coverage,
         avg(CAST(x.y >= x.lo - c.correction AND x.y <= x.hi + c.correction AS DOUBLE)) AS calibrated_coverage
  FROM sc_cs x CROSS JOIN sc_conf c
  GROUP BY c.target_coverage, c.correction, c.calibration_rows)"""
    tst = f"""sc_test AS (
  SELECT e.*, least(e.{n['lo_raw']} - c.correction, e.{n['pred']}) AS {n['lo']},
              greatest(e.{n['hi_raw']} + c.correction, e.{n['pred']}) AS {n['hi']}
  FROM sc_env e CROSS JOIN sc_conf c WHERE e.snapshot_date = DATE '{test}')"""
    return [*snap, raw, pred, env, cs, conf, conf2, tst]
