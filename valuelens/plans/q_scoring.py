"""Registered queries: baselines, conformal intervals, evaluation, deciles, policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformal, evaluation as ev, policy as pol
from ..operators import snapshots_margin as sm
from ..operators import snapshots_revenue as sr
from ..operators.scoring import MARGIN_NAMES, REVENUE_NAMES, closed_form_scores
from ..session import drop_materialized, materialize
from . import sql_fixtures as S
from . import sql_scoring as Q
from .common import (
    DISCOUNT_RATE, HORIZON_DAYS, LOOKBACK_DAYS, MARGIN_DATES, REVENUE_DATES,
    fx_customers, fx_orders, fx_transactions, round_doubles,
)

KEYS = ["customer_id", "snapshot_date"]


def _snapshots(spark, sf, path, dates, orders=None):
    if path == "margin":
        orders = orders if orders is not None else fx_orders(spark, sf)
        return sm.margin_snapshots(fx_customers(spark, sf, orders), orders, dates,
                                   LOOKBACK_DAYS, HORIZON_DAYS, DISCOUNT_RATE)
    return sr.revenue_snapshots(fx_transactions(spark, sf), dates, LOOKBACK_DAYS, HORIZON_DAYS)


def _names(path):
    return MARGIN_NAMES if path == "margin" else REVENUE_NAMES


def _dates(path):
    return (Q.MARGIN_CAL_DATE, Q.MARGIN_TEST_DATE) if path == "margin" else (Q.REVENUE_CAL_DATE, Q.REVENUE_TEST_DATE)


def scored_env(spark, sf, path="margin"):
    """Both calibration and test dates, closed-form scores with raw intervals.

    Written once under the shared checkpoint folder: conformal calibration, the
    test frame and every metric read it instead of re-running the snapshot plan.
    The margin path's orders are written too, until then: acquisition dates and windows
    both read them, and lines meet their parts once.
    """
    orders = materialize(fx_orders(spark, sf).drop("order_channel"), "orders") if path == "margin" else None
    env = materialize(closed_form_scores(_snapshots(spark, sf, path, list(_dates(path)), orders), path),
                      f"scores-{path}")
    if orders is not None:
        drop_materialized(orders)
    return env


def correction_frame(spark, sf, path="margin", env=None):
    n = _names(path)
    env = env if env is not None else scored_env(spark, sf, path)
    cal = env.filter(F.col("snapshot_date") == F.lit(_dates(path)[0]).cast("date"))
    return conformal.conformal_correction(cal, n["actual"], n["lower_raw"], n["upper_raw"], KEYS,
                                          Q.TARGET_COVERAGE)


def scored_test(spark, sf, path="margin"):
    """Test-date frame with raw and calibrated intervals.

    Nothing is written a second time: the stored scores, with the correction as a number.
    """
    n = _names(path)
    env = scored_env(spark, sf, path)
    corr = F.lit(correction_frame(spark, sf, path, env).select("correction").first()[0]).cast("double")
    test = env.filter(F.col("snapshot_date") == F.lit(_dates(path)[1]).cast("date"))
    lo, hi = conformal.apply_correction(F.col(n["pred"]), F.col(n["lower_raw"]), F.col(n["upper_raw"]), corr)
    return test.withColumn(n["lower"], lo).withColumn(n["upper"], hi)


# ---------------------------------------------------------------- queries

def baseline_margin(spark, sf):
    s = closed_form_scores(_snapshots(spark, sf, "margin", MARGIN_DATES), "margin")
    return s.select(*KEYS, "baseline_clv_180d")


def baseline_revenue(spark, sf):
    s = closed_form_scores(_snapshots(spark, sf, "revenue", REVENUE_DATES), "revenue")
    return s.select(*KEYS, "baseline_revenue_180d")


def interval_envelope(spark, sf):
    n = MARGIN_NAMES
    return round_doubles(scored_env(spark, sf).select(*KEYS, n["pred"], n["prob"], n["lower_raw"], n["upper_raw"]))


def conformal_correction(spark, sf):
    return round_doubles(correction_frame(spark, sf))


def conformal_correction_revenue(spark, sf):
    return round_doubles(correction_frame(spark, sf, "revenue"))


def conformal_apply(spark, sf):
    n = MARGIN_NAMES
    return round_doubles(scored_test(spark, sf).select(*KEYS, n["pred"], n["lower_raw"], n["upper_raw"],
                                                       n["lower"], n["upper"]))


def _metric_query(fn):
    def q(spark, sf, path="margin"):
        return round_doubles(fn(scored_test(spark, sf, path), _names(path)))
    return q


error_metrics = _metric_query(lambda d, n: ev.error_metrics(d, n["actual"], n["pred"]))
spearman = _metric_query(lambda d, n: ev.spearman(d, n["actual"], n["pred"], KEYS))
top_capture = _metric_query(lambda d, n: ev.top_capture(d, n["actual"], n["pred"], KEYS))
interval_coverage = _metric_query(lambda d, n: ev.interval_coverage(d, n["actual"], n["lower"], n["upper"]))
average_precision = _metric_query(lambda d, n: ev.average_precision(d, n["active"], n["prob"]))
brier = _metric_query(lambda d, n: ev.brier(d, n["active"], n["prob"]))
portfolio_checks = _metric_query(lambda d, n: ev.portfolio_checks(d, n["actual"], n["pred"]))


def _full_evaluation(d, n):
    yr = ev.value_ranks(d, n["actual"], KEYS, "_ry")
    model = ev.regression_metrics(d, n["actual"], n["pred"], KEYS, n["lower"], n["upper"], yr)
    raw = ev.interval_coverage(d, n["actual"], n["lower_raw"], n["upper_raw"], "raw") \
        .withColumnRenamed("raw_80_coverage", "interval_80_raw_coverage") \
        .withColumnRenamed("raw_mean_width", "interval_raw_mean_width")
    act = ev.average_precision(d, n["active"], n["prob"]).crossJoin(ev.brier(d, n["active"], n["prob"]))
    port = ev.portfolio_checks(d, n["actual"], n["pred"])
    model_all = model.crossJoin(raw).crossJoin(act).crossJoin(port)
    base = ev.regression_metrics(d, n["actual"], n["baseline"], KEYS, actual_ranks=yr)
    return ev.to_long(model_all, "model").unionByName(ev.to_long(base, "baseline"))


full_evaluation = _metric_query(_full_evaluation)


def full_evaluation_revenue(spark, sf):
    return full_evaluation(spark, sf, "revenue")


def _deciled(spark, sf, path="margin"):
    n = _names(path)
    return ev.assign_deciles(scored_test(spark, sf, path), n["pred"], KEYS)


def deciles(spark, sf):
    return _deciled(spark, sf).select(*KEYS, "predicted_value_decile")


def value_by_decile(spark, sf, path="margin"):
    n = _names(path)
    return round_doubles(ev.decile_value_summary(_deciled(spark, sf, path), "predicted_value_decile",
                                                 n["actual"], n["pred"]))


def value_by_decile_revenue(spark, sf):
    return value_by_decile(spark, sf, "revenue")


def interval_by_decile(spark, sf, path="margin"):
    n = _names(path)
    return round_doubles(ev.interval_diagnostics(_deciled(spark, sf, path), "predicted_value_decile",
                                                 n["actual"], n["lower_raw"], n["upper_raw"], n["lower"], n["upper"]))


def interval_by_decile_revenue(spark, sf):
    return interval_by_decile(spark, sf, "revenue")


def top_decile_interval(spark, sf, path="revenue"):
    d = interval_by_decile(spark, sf, path)
    return d.filter(F.col("predicted_value_decile") == 10).select(
        F.col("calibrated_coverage").alias("highest_value_decile_coverage"),
        F.col("calibrated_mean_width").alias("highest_value_decile_mean_width"))


def capture_curve(spark, sf, path="margin"):
    n = _names(path)
    d = scored_test(spark, sf, path)
    m = ev.capture_curve(d, n["actual"], n["pred"], KEYS).withColumn("scorer", F.lit("model"))
    b = ev.capture_curve(d, n["actual"], n["baseline"], KEYS).withColumn("scorer", F.lit("baseline"))
    return round_doubles(m.unionByName(b))


def capture_curve_revenue(spark, sf):
    return capture_curve(spark, sf, "revenue")


# ---- policy (margin path)

def _decided(spark, sf):
    n = MARGIN_NAMES
    d = scored_test(spark, sf)
    policy = pol.DEFAULT_POLICY
    decided = pol.apply_policy(d, policy, n["pred"], n["lower"], n["upper"], ["snapshot_date", "customer_id"])
    return pol.add_flags(decided, policy, n["pred"], n["lower_raw"], n["upper_raw"], "_raw")


def tier_capacity(spark, sf):
    return pol.tier_capacity_table(scored_test(spark, sf), pol.DEFAULT_POLICY["tier_shares"])


def tier_assignment(spark, sf):
    return _decided(spark, sf).select(*KEYS, "service_tier")


def policy_scores(spark, sf):
    return round_doubles(_decided(spark, sf).select(
        *KEYS, "service_tier", F.col("high_uncertainty").cast("int").alias("high_uncertainty"),
        "investment_ceiling", F.col("high_uncertainty_raw").cast("int").alias("high_uncertainty_raw"),
        "investment_ceiling_raw"))


def policy_impact(spark, sf):
    return round_doubles(pol.policy_impact(_decided(spark, sf)))


def policy_summary(spark, sf):
    n = MARGIN_NAMES
    return round_doubles(pol.policy_summary(_decided(spark, sf), n["pred"], n["actual"]))


def interval_by_tier(spark, sf):
    n = MARGIN_NAMES
    return round_doubles(ev.interval_diagnostics(_decided(spark, sf), "service_tier", n["actual"],
                                                 n["lower_raw"], n["upper_raw"], n["lower"], n["upper"]))


def wape_reduction(spark, sf):
    n = MARGIN_NAMES
    d = _decided(spark, sf)
    w = d.agg(ev.wape_expr(F.col(n["actual"]), F.col(n["pred"])).alias("_wm"),
              ev.wape_expr(F.col(n["actual"]), F.col(n["baseline"])).alias("_wb"))
    s = pol.policy_summary(d, n["pred"], n["actual"]).filter(F.col("service_tier") == "protect") \
        .select(F.col("realized_value_share").alias("protect_tier_realized_value_share"),
                F.col("customer_share").alias("protect_tier_customer_share"))
    out = w.select((F.lit(1.0) - F.try_divide(F.col("_wm"), F.col("_wb"))).alias("relative_wape_reduction_vs_baseline"))
    return round_doubles(out.crossJoin(s))


def flagship(spark, sf):
    """Margin snapshots -> closed-form score -> conformal -> tiers -> per-tier summary."""
    return policy_summary(spark, sf)


QUERIES = {
    "baseline_margin": baseline_margin,
    "baseline_revenue": baseline_revenue,
    "interval_envelope": interval_envelope,
    "conformal_correction": conformal_correction,
    "conformal_correction_revenue": conformal_correction_revenue,
    "conformal_apply": conformal_apply,
    "error_metrics": error_metrics,
    "spearman": spearman,
    "top_capture": top_capture,
    "interval_coverage": interval_coverage,
    "average_precision": average_precision,
    "brier": brier,
    "portfolio_checks": portfolio_checks,
    "full_evaluation": full_evaluation,
    "full_evaluation_revenue": full_evaluation_revenue,
    "deciles": deciles,
    "value_by_decile": value_by_decile,
    "value_by_decile_revenue": value_by_decile_revenue,
    "interval_by_decile": interval_by_decile,
    "interval_by_decile_revenue": interval_by_decile_revenue,
    "top_decile_interval": top_decile_interval,
    "capture_curve": capture_curve,
    "capture_curve_revenue": capture_curve_revenue,
    "tier_capacity": tier_capacity,
    "tier_assignment": tier_assignment,
    "policy_scores": policy_scores,
    "policy_impact": policy_impact,
    "policy_summary": policy_summary,
    "interval_by_tier": interval_by_tier,
    "wape_reduction": wape_reduction,
}

# ---------------------------------------------------------------- oracle SQL

_MS = Q.score_ctes("margin")
_RS = Q.score_ctes("revenue")
_MN, _RN = MARGIN_NAMES, REVENUE_NAMES


def _w(ctes, body, dbl=()):
    return S.round_cols(S.with_ctes(*ctes, body=body), list(dbl))


def _metrics_sql(n, extra_ctes=()):
    """CTE m_rank: test rows with rn (pred desc, keys) and n."""
    return [f"""m_rank AS (
  SELECT *, {n['actual']} AS y, {n['pred']} AS p,
         row_number() OVER (ORDER BY {n['pred']} DESC, customer_id, snapshot_date) AS rn,
         count(*) OVER () AS cnt
  FROM sc_test)"""]


def _avg_rank(col, name):
    return (f"(rank() OVER (ORDER BY {col}) + count(*) OVER (PARTITION BY {col}) - 1 "
            f"+ rank() OVER (ORDER BY {col})) / 2.0::DOUBLE AS {name}")


def _spearman_sql(n, score):
    return f"""sp AS (
  SELECT CASE WHEN min(y) = max(y) OR min(p) = max(p) THEN 0.0::DOUBLE
              ELSE COALESCE(covar_pop(ry, rp) / NULLIF(stddev_pop(ry) * stddev_pop(rp), 0), 0.0::DOUBLE) END AS spearman
  FROM (SELECT y, p, {_avg_rank('y', 'ry')}, {_avg_rank('p', 'rp')}
        FROM (SELECT {n['actual']} AS y, {score} AS p FROM sc_test) a) b)"""


def _capture_cols(score_rank="rn"):
    out = []
    for f in (10, 20):
        k = f"greatest(1, CAST(ceil(CAST(cnt AS DOUBLE) * {f / 100}::DOUBLE) AS BIGINT))"
        out.append(f"CASE WHEN sum(y) = 0 THEN 0.0::DOUBLE ELSE sum(CASE WHEN {score_rank} <= {k} THEN y ELSE 0.0::DOUBLE END) / sum(y) END AS top_{f}_value_capture")
    return ", ".join(out)


def _reg_sql(n, score, with_interval):
    rank = f"""rk AS (
  SELECT {n['actual']} AS y, {score} AS p, {n['lower']} AS lo, {n['upper']} AS hi,
         row_number() OVER (ORDER BY {score} DESC, customer_id, snapshot_date) AS rn, count(*) OVER () AS cnt
  FROM sc_test)"""
    cols = ["avg(abs(y - p)) AS mae",
            "COALESCE(sum(abs(y - p)) / NULLIF(sum(abs(y)), 0), 0.0::DOUBLE) AS wape",
            "sqrt(avg((y - p) * (y - p))) AS rmse", _capture_cols()]
    if with_interval:
        cols += ["avg(CAST(y >= lo AND y <= hi AS DOUBLE)) AS interval_80_coverage", "avg(hi - lo) AS interval_mean_width"]
    return [rank, _spearman_sql(n, score)], f"SELECT {', '.join(cols)}, (SELECT spearman FROM sp) AS spearman FROM rk"


def _ap_sql(n):
    return f"""ap AS (
  SELECT COALESCE(sum(tp * ctp / ccnt) / NULLIF(sum(tp), 0), 0.0::DOUBLE) AS activity_average_precision
  FROM (SELECT tp, sum(tp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp,
               sum(cnt) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ccnt
        FROM (SELECT {n['prob']} AS score, sum(CAST({n['active']} AS DOUBLE)) AS tp, CAST(count(*) AS DOUBLE) AS cnt
              FROM sc_test GROUP BY {n['prob']}) g) c)"""


def _full_eval_sql(n, ctes):
    mc, mbody = _reg_sql(n, n["pred"], True)
    bc, bbody = _reg_sql(n, n["baseline"], False)
    bc = [c.replace("rk AS", "rkb AS").replace("sp AS", "spb AS") for c in bc]
    bbody = bbody.replace("FROM sp", "FROM spb").replace("FROM rk", "FROM rkb")
    model = f"""mm AS ({mbody}),
mraw AS (SELECT avg(CAST({n['actual']} >= {n['lower_raw']} AND {n['actual']} <= {n['upper_raw']} AS DOUBLE)) AS interval_80_raw_coverage,
                avg({n['upper_raw']} - {n['lower_raw']}) AS interval_raw_mean_width,
                avg(({n['prob']} - {n['active']}) * ({n['prob']} - {n['active']})) AS activity_brier_score,
                CASE WHEN sum({n['actual']}) = 0 THEN 0.0::DOUBLE ELSE sum({n['pred']}) / sum({n['actual']}) END AS aggregate_prediction_to_actual_ratio,
                avg(CAST({n['pred']} < 0 AS DOUBLE)) AS negative_prediction_rate,
                avg(CAST({n['actual']} < 0 AS DOUBLE)) AS negative_realized_value_rate FROM sc_test),
bm AS ({bbody})"""
    body = """SELECT 'model' AS scorer, metric, round(value, 6) + 0.0 AS value FROM (
  UNPIVOT (SELECT * FROM mm, mraw, ap) ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL
SELECT 'baseline' AS scorer, metric, round(value, 6) + 0.0 AS value FROM (
  UNPIVOT (SELECT * FROM bm) ON COLUMNS(*) INTO NAME metric VALUE value)"""
    return S.with_ctes(*ctes, *mc, *bc, _ap_sql(n), model, body=body)


_DEC = """dec AS (
  SELECT *, CASE WHEN cnt <= 1 THEN 1
                 ELSE greatest(1, CAST((10 * (rn - 1) + cnt - 2) // (cnt - 1) AS INTEGER)) END AS predicted_value_decile
  FROM (SELECT *, row_number() OVER (ORDER BY {pred}, customer_id, snapshot_date) AS rn, count(*) OVER () AS cnt
        FROM sc_test) z)"""


def _interval_diag_sql(n, group):
    y = n["actual"]
    return f"""SELECT {group}, count(customer_id) AS customers,
  avg(CAST({y} >= {n['lower_raw']} AND {y} <= {n['upper_raw']} AS DOUBLE)) AS raw_coverage,
  avg(CAST({y} >= {n['lower']} AND {y} <= {n['upper']} AS DOUBLE)) AS calibrated_coverage,
  avg({n['upper_raw']} - {n['lower_raw']}) AS raw_mean_width,
  avg({n['upper']} - {n['lower']}) AS calibrated_mean_width"""


_DIAG_DBL = ["raw_coverage", "calibrated_coverage", "raw_mean_width", "calibrated_mean_width"]


def _value_by_decile_sql(n, ctes):
    body = f"""SELECT predicted_value_decile, count(customer_id) AS customers,
  avg({n['pred']}) AS average_predicted_value, avg({n['actual']}) AS average_realized_value,
  sum({n['actual']}) AS realized_value,
  sum({n['actual']}) / (SELECT sum({n['actual']}) FROM sc_test) AS realized_value_share
FROM dec GROUP BY predicted_value_decile"""
    return _w([*ctes, _DEC.format(pred=n["pred"])], body,
              ["average_predicted_value", "average_realized_value", "realized_value", "realized_value_share"])


def _capture_curve_sql(n, ctes):
    def one(score, name):
        return f"""SELECT '{name}' AS scorer, g.p AS coverage_point,
  CAST(ceil(CAST(c.cnt AS DOUBLE) * g.p / 100.0::DOUBLE) AS BIGINT) AS customers,
  CAST(ceil(CAST(c.cnt AS DOUBLE) * g.p / 100.0::DOUBLE) AS DOUBLE) / c.cnt AS customer_share,
  (SELECT sum(y) FROM (SELECT {n['actual']} AS y, row_number() OVER (ORDER BY {score} DESC, customer_id, snapshot_date) AS rn FROM sc_test) r
     WHERE r.rn <= ceil(CAST(c.cnt AS DOUBLE) * g.p / 100.0::DOUBLE)) / c.total AS captured_value_share
FROM (SELECT CAST(range AS INTEGER) AS p FROM range(1, 101)) g,
     (SELECT count(*) AS cnt, sum({n['actual']}) AS total FROM sc_test) c"""
    return _w(ctes, one(n["pred"], "model") + "\nUNION ALL\n" + one(n["baseline"], "baseline"),
              ["customer_share", "captured_value_share"])


_POLICY = pol.DEFAULT_POLICY


def _policy_ctes(n):
    sh = _POLICY["tier_shares"]
    t = pol.TIER_ORDER
    ex = [f"(cnt * {float(sh[x])}::DOUBLE)" for x in t]
    fl = [f"floor({e})" for e in ex]
    fr = [f"({e} - {f})" for e, f in zip(ex, fl)]
    rem = f"(cnt - ({' + '.join(fl)}))"
    counts = []
    for i in range(4):
        ahead = " + ".join(f"CAST({fr[j]} > {fr[i]} OR ({fr[j]} = {fr[i]} AND {str(j < i).upper()}) AS INTEGER)"
                           for j in range(4) if j != i)
        counts.append(f"CAST({fl[i]} + CAST(({ahead}) < {rem} AS INTEGER) AS BIGINT) AS c{i + 1}")
    cap = (f"(SELECT cnt, {', '.join(counts)} FROM (SELECT count(*) AS cnt FROM sc_test) z)")
    caps = _POLICY["tier_caps"]
    frac = float(_POLICY["investment_fraction"])
    ratio = float(_POLICY["uncertainty_ratio"])

    def cap_of(col):
        return "CASE " + " ".join(f"WHEN {col} = '{x}' THEN {float(caps[x])}::DOUBLE" for x in t) + " END"
    tiered = f"""pt AS (
  SELECT s.*, CASE WHEN rn <= c.c1 THEN 'protect' WHEN rn <= c.c1 + c.c2 THEN 'grow'
                   WHEN rn <= c.c1 + c.c2 + c.c3 THEN 'nurture' ELSE 'low_touch' END AS service_tier
  FROM (SELECT *, row_number() OVER (ORDER BY {n['pred']} DESC, snapshot_date, customer_id) AS rn FROM sc_test) s,
       {cap} c)"""
    flags = f"""pf AS (
  SELECT *,
    ({n['upper']} - {n['lower']}) / greatest({n['pred']}, 1.0::DOUBLE) > {ratio}::DOUBLE AS high_uncertainty,
    greatest(least({n['lower']} * {frac}::DOUBLE, {cap_of('service_tier')}), 0.0::DOUBLE) AS investment_ceiling,
    ({n['upper_raw']} - {n['lower_raw']}) / greatest({n['pred']}, 1.0::DOUBLE) > {ratio}::DOUBLE AS high_uncertainty_raw,
    greatest(least({n['lower_raw']} * {frac}::DOUBLE, {cap_of('service_tier')}), 0.0::DOUBLE) AS investment_ceiling_raw
  FROM pt)"""
    tiers = "tiers AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{x}')" for i, x in enumerate(t)) + \
        ") v(tier_rank, service_tier))"
    summary = f"""ps AS (
  SELECT t.tier_rank, t.service_tier, g.customers, g.predicted_value, g.realized_value, g.investment_ceiling,
         g.high_uncertainty_rate,
         CAST(g.customers AS DOUBLE) / sum(g.customers) OVER () AS customer_share,
         g.realized_value / sum(g.realized_value) OVER () AS realized_value_share
  FROM tiers t LEFT JOIN (
    SELECT service_tier, count(customer_id) AS customers, sum({n['pred']}) AS predicted_value,
           sum({n['actual']}) AS realized_value, sum(investment_ceiling) AS investment_ceiling,
           avg(CAST(high_uncertainty AS DOUBLE)) AS high_uncertainty_rate
    FROM pf GROUP BY service_tier) g ON g.service_tier = t.service_tier)"""
    return [tiered, flags, tiers, summary], cap


def _sql_all():
    out = {}
    m, r = _MN, _RN
    out["baseline_margin"] = S.with_ctes(*S.margin_snapshot_ctes(), body=(
        "SELECT customer_id, snapshot_date, round(" + Q._trail("margin_180d", "margin_90d", "margin_previous_90d", "10.0", "0.45")
        + ", 6) + 0.0 AS baseline_clv_180d FROM m_snap"))
    out["baseline_revenue"] = S.with_ctes(*S.revenue_snapshot_ctes(), body=(
        "SELECT customer_id, snapshot_date, round(" + Q._trail("net_revenue_180d", "net_revenue_90d", "net_revenue_previous_90d", "1.0", "0.5")
        + ", 6) + 0.0 AS baseline_revenue_180d FROM r_snap"))
    out["interval_envelope"] = _w(_MS, f"SELECT customer_id, snapshot_date, {m['pred']}, active_probability_180d, {m['lower_raw']}, {m['upper_raw']} FROM sc_env",
                                  [m["pred"], "active_probability_180d", m["lower_raw"], m["upper_raw"]])
    conf_cols = ["target_coverage", "correction", "raw_coverage", "calibrated_coverage"]
    out["conformal_correction"] = _w(_MS, "SELECT target_coverage, correction, calibration_rows, raw_coverage, calibrated_coverage FROM sc_conf2", conf_cols)
    out["conformal_correction_revenue"] = _w(_RS, "SELECT target_coverage, correction, calibration_rows, raw_coverage, calibrated_coverage FROM sc_conf2", conf_cols)
    out["conformal_apply"] = _w(_MS, f"SELECT customer_id, snapshot_date, {m['pred']}, {m['lower_raw']}, {m['upper_raw']}, {m['lower']}, {m['upper']} FROM sc_test",
                                [m["pred"], m["lower_raw"], m["upper_raw"], m["lower"], m["upper"]])
    out["error_metrics"] = _w(_MS, f"""SELECT avg(abs({m['actual']} - {m['pred']})) AS mae,
  COALESCE(sum(abs({m['actual']} - {m['pred']})) / NULLIF(sum(abs({m['actual']})), 0), 0.0::DOUBLE) AS wape,
  sqrt(avg(({m['actual']} - {m['pred']}) * ({m['actual']} - {m['pred']}))) AS rmse FROM sc_test""", ["mae", "wape", "rmse"])
    out["spearman"] = _w([*_MS, _spearman_sql(m, m["pred"])], "SELECT spearman FROM sp", ["spearman"])
    out["top_capture"] = _w([*_MS, *_metrics_sql(m)], f"SELECT {_capture_cols()} FROM m_rank",
                            ["top_10_value_capture", "top_20_value_capture"])
    out["interval_coverage"] = _w(_MS, f"""SELECT avg(CAST({m['actual']} >= {m['lower']} AND {m['actual']} <= {m['upper']} AS DOUBLE)) AS interval_80_coverage,
  avg({m['upper']} - {m['lower']}) AS interval_mean_width FROM sc_test""", ["interval_80_coverage", "interval_mean_width"])
    out["average_precision"] = _w([*_MS, _ap_sql(m)], "SELECT activity_average_precision FROM ap", ["activity_average_precision"])
    out["brier"] = _w(_MS, f"SELECT avg(({m['prob']} - {m['active']}) * ({m['prob']} - {m['active']})) AS activity_brier_score FROM sc_test",
                      ["activity_brier_score"])
    out["portfolio_checks"] = _w(_MS, f"""SELECT CASE WHEN sum({m['actual']}) = 0 THEN 0.0::DOUBLE ELSE sum({m['pred']}) / sum({m['actual']}) END AS aggregate_prediction_to_actual_ratio,
  avg(CAST({m['pred']} < 0 AS DOUBLE)) AS negative_prediction_rate,
  avg(CAST({m['actual']} < 0 AS DOUBLE)) AS negative_realized_value_rate FROM sc_test""",
                                 ["aggregate_prediction_to_actual_ratio", "negative_prediction_rate", "negative_realized_value_rate"])
    out["full_evaluation"] = _full_eval_sql(m, _MS)
    out["full_evaluation_revenue"] = _full_eval_sql(r, _RS)
    out["deciles"] = S.with_ctes(*_MS, _DEC.format(pred=m["pred"]), body="SELECT customer_id, snapshot_date, predicted_value_decile FROM dec")
    out["value_by_decile"] = _value_by_decile_sql(m, _MS)
    out["value_by_decile_revenue"] = _value_by_decile_sql(r, _RS)
    out["interval_by_decile"] = _w([*_MS, _DEC.format(pred=m["pred"])], _interval_diag_sql(m, "predicted_value_decile") + " FROM dec GROUP BY predicted_value_decile", _DIAG_DBL)
    out["interval_by_decile_revenue"] = _w([*_RS, _DEC.format(pred=r["pred"])], _interval_diag_sql(r, "predicted_value_decile") + " FROM dec GROUP BY predicted_value_decile", _DIAG_DBL)
    out["top_decile_interval"] = _w([*_RS, _DEC.format(pred=r["pred"])], f"""SELECT calibrated_coverage AS highest_value_decile_coverage, calibrated_mean_width AS highest_value_decile_mean_width
FROM ({_interval_diag_sql(r, 'predicted_value_decile')} FROM dec GROUP BY predicted_value_decile) z WHERE predicted_value_decile = 10""",
                                    ["highest_value_decile_coverage", "highest_value_decile_mean_width"])
    out["capture_curve"] = _capture_curve_sql(m, _MS)
    out["capture_curve_revenue"] = _capture_curve_sql(r, _RS)
    pc, cap = _policy_ctes(m)
    out["tier_capacity"] = S.with_ctes(*_MS, body=(
        f"SELECT tier_rank, service_tier, customers FROM (SELECT * FROM {cap} c) z, "
        "LATERAL (SELECT * FROM (VALUES (1, 'protect', z.c1), (2, 'grow', z.c2), (3, 'nurture', z.c3), (4, 'low_touch', z.c4)) v(tier_rank, service_tier, customers))"))
    out["tier_assignment"] = S.with_ctes(*_MS, *pc, body="SELECT customer_id, snapshot_date, service_tier FROM pt")
    out["policy_scores"] = _w([*_MS, *pc], """SELECT customer_id, snapshot_date, service_tier, CAST(high_uncertainty AS INTEGER) AS high_uncertainty,
  investment_ceiling, CAST(high_uncertainty_raw AS INTEGER) AS high_uncertainty_raw, investment_ceiling_raw FROM pf""",
                              ["investment_ceiling", "investment_ceiling_raw"])
    out["policy_impact"] = _w([*_MS, *pc], """SELECT avg(CAST(high_uncertainty_raw AS DOUBLE)) AS raw_high_uncertainty_rate,
  avg(CAST(high_uncertainty AS DOUBLE)) AS calibrated_high_uncertainty_rate,
  CAST(sum(CAST(NOT high_uncertainty_raw AND high_uncertainty AS INTEGER)) AS BIGINT) AS customers_newly_flagged_high_uncertainty,
  sum(investment_ceiling_raw) AS raw_total_investment_ceiling, sum(investment_ceiling) AS calibrated_total_investment_ceiling FROM pf""",
                              ["raw_high_uncertainty_rate", "calibrated_high_uncertainty_rate", "raw_total_investment_ceiling", "calibrated_total_investment_ceiling"])
    ps_dbl = ["predicted_value", "realized_value", "investment_ceiling", "high_uncertainty_rate", "customer_share", "realized_value_share"]
    out["policy_summary"] = _w([*_MS, *pc], "SELECT * FROM ps", ps_dbl)
    out["interval_by_tier"] = _w([*_MS, *pc], _interval_diag_sql(m, "service_tier") + " FROM pf GROUP BY service_tier", _DIAG_DBL)
    out["wape_reduction"] = _w([*_MS, *pc], f"""SELECT 1.0::DOUBLE - (COALESCE(sum(abs({m['actual']} - {m['pred']})) / NULLIF(sum(abs({m['actual']})), 0), 0.0::DOUBLE))
   / (COALESCE(sum(abs({m['actual']} - {m['baseline']})) / NULLIF(sum(abs({m['actual']})), 0), 0.0::DOUBLE)) AS relative_wape_reduction_vs_baseline,
  (SELECT realized_value_share FROM ps WHERE service_tier = 'protect') AS protect_tier_realized_value_share,
  (SELECT customer_share FROM ps WHERE service_tier = 'protect') AS protect_tier_customer_share
FROM sc_test""", ["relative_wape_reduction_vs_baseline", "protect_tier_realized_value_share", "protect_tier_customer_share"])
    return out


SQL = _sql_all()
