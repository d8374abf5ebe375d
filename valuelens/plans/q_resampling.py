"""Registered queries: paired bootstrap (G11) and permutation importance (F13, G17)."""

from __future__ import annotations

from ..functions.columns import r6
from ..operators import bootstrap as bs
from ..operators import importance as imp
from ..operators.baseline import margin_baseline, revenue_baseline
from ..operators.scoring import MARGIN_NAMES, REVENUE_NAMES
from ..operators.snapshots_margin import MARGIN_CATEGORICAL, MARGIN_FEATURES
from ..operators.snapshots_revenue import REVENUE_CATEGORICAL, REVENUE_FEATURES
from . import sql_fixtures as S
from . import sql_scoring as Q
from .common import round_doubles
from .q_scoring import KEYS, scored_test

BOOT_ITERATIONS = 1000
SEED = 42


def bootstrap_comparison(spark, sf):
    n = REVENUE_NAMES
    d = scored_test(spark, sf, "revenue")
    return round_doubles(bs.paired_bootstrap(d, n["actual"], n["pred"], n["baseline"], KEYS,
                                             BOOT_ITERATIONS, SEED, 0.95, draw_hash="md5"))


def _importance(spark, sf, path="margin"):
    d = scored_test(spark, sf, path)
    names = MARGIN_NAMES if path == "margin" else REVENUE_NAMES
    feats, cats = (MARGIN_FEATURES, MARGIN_CATEGORICAL) if path == "margin" else (REVENUE_FEATURES, REVENUE_CATEGORICAL)
    scorer = r6(margin_baseline() if path == "margin" else revenue_baseline())
    cols = [*KEYS, names["actual"], *feats]
    return imp.permutation_importance(d.select(*cols), feats, cats, names["actual"],
                                      imp.expression_scorer(scorer), KEYS, SEED)


def permutation_importance(spark, sf):
    return round_doubles(_importance(spark, sf))


def permutation_importance_revenue(spark, sf):
    return round_doubles(_importance(spark, sf, "revenue"))


def top_importance(spark, sf):
    return round_doubles(imp.top_features(_importance(spark, sf), 10))


QUERIES = {
    "bootstrap_comparison": bootstrap_comparison,
    "permutation_importance": permutation_importance,
    "permutation_importance_revenue": permutation_importance_revenue,
    "top_importance": top_importance,
}


def _bootstrap_sql():
    r = REVENUE_NAMES
    ctes = Q.score_ctes("revenue")
    rows = f"""bs_rows AS (
  SELECT {r['actual']} AS y, {r['pred']} AS m, {r['baseline']} AS b,
         row_number() OVER (ORDER BY customer_id, snapshot_date) AS rid,
         row_number() OVER (ORDER BY {r['actual']}, customer_id, snapshot_date) AS pos_y,
         row_number() OVER (ORDER BY {r['pred']} DESC, customer_id, snapshot_date) AS pos_m,
         row_number() OVER (ORDER BY {r['baseline']} DESC, customer_id, snapshot_date) AS pos_b
  FROM sc_test)"""
    nn = "bs_n AS (SELECT count(*) AS n FROM bs_rows)"
    draws = f"""bs_draws AS (
  SELECT it, rid, count(*) AS w FROM (
    SELECT it, (('0x' || substr(md5('{SEED}|' || CAST(it AS VARCHAR) || '|' || CAST(draw AS VARCHAR)), 1, 15))::BIGINT % n) + 1 AS rid
    FROM (SELECT CAST(i.range AS BIGINT) AS it, unnest(generate_series(0, bs_n.n - 1)) AS draw, bs_n.n AS n
          FROM bs_n, range(0, {BOOT_ITERATIONS}) i) g) h
  GROUP BY it, rid
  UNION ALL SELECT -1 AS it, rid, 1 AS w FROM bs_rows)"""
    wt = """bs_w AS (
  SELECT d.it, d.w, r.*, n.n,
         sum(d.w) OVER (PARTITION BY d.it ORDER BY r.pos_y ROWS UNBOUNDED PRECEDING) AS cy,
         sum(d.w) OVER (PARTITION BY d.it ORDER BY r.pos_m ROWS UNBOUNDED PRECEDING) AS cm,
         sum(d.w) OVER (PARTITION BY d.it ORDER BY r.pos_b ROWS UNBOUNDED PRECEDING) AS cb
  FROM bs_draws d JOIN bs_rows r USING (rid) CROSS JOIN bs_n n)"""
    ranks = """bs_r AS (
  SELECT x.*, 
    (min(cy - w) OVER (PARTITION BY it, y)) + (sum(w) OVER (PARTITION BY it, y) + 1) / 2.0::DOUBLE AS ry,
    (n - min(cm - w) OVER (PARTITION BY it, m) - sum(w) OVER (PARTITION BY it, m)) + (sum(w) OVER (PARTITION BY it, m) + 1) / 2.0::DOUBLE AS rm,
    (n - min(cb - w) OVER (PARTITION BY it, b) - sum(w) OVER (PARTITION BY it, b)) + (sum(w) OVER (PARTITION BY it, b) + 1) / 2.0::DOUBLE AS rb
  FROM bs_w x)"""

    def pear(rx):
        cov = f"(sum(w * ry * {rx}) - sum(w * ry) * sum(w * {rx}) / n)"
        den = f"sqrt((sum(w * ry * ry) - sum(w * ry) * sum(w * ry) / n) * (sum(w * {rx} * {rx}) - sum(w * {rx}) * sum(w * {rx}) / n))"
        return f"COALESCE({cov} / NULLIF({den}, 0), 0.0::DOUBLE)"

    def spear(rx, s):
        return f"CASE WHEN min(y) = max(y) OR min({s}) = max({s}) THEN 0.0::DOUBLE ELSE {pear(rx)} END"

    def wape(s):
        return f"COALESCE(sum(w * abs(y - {s})) / NULLIF(sum(w * abs(y)), 0), 0.0::DOUBLE)"

    def cap(c, f):
        k = f"greatest(1.0::DOUBLE, CAST(ceil(CAST(n AS DOUBLE) * {f}::DOUBLE) AS DOUBLE))"
        take = f"least(greatest({k} - ({c} - w), 0.0::DOUBLE), CAST(w AS DOUBLE))"
        return f"CASE WHEN sum(w * y) = 0 THEN 0.0::DOUBLE ELSE sum(y * {take}) / sum(w * y) END"

    per = f"""bs_it AS (
  SELECT it,
    {wape('m')} - {wape('b')} AS wape_difference,
    {spear('rm', 'm')} - {spear('rb', 'b')} AS spearman_difference,
    {cap('cm', 0.1)} - {cap('cb', 0.1)} AS top_10_capture_difference,
    {cap('cm', 0.2)} - {cap('cb', 0.2)} AS top_20_capture_difference
  FROM bs_r GROUP BY it, n)"""
    long = """bs_long AS (UNPIVOT bs_it ON wape_difference, spearman_difference, top_10_capture_difference, top_20_capture_difference
  INTO NAME metric VALUE v)"""
    body = """SELECT e.metric, e.v AS estimate, s.ci_lower, s.ci_upper, 0.95::DOUBLE AS confidence, s.probability_model_better,
       CASE WHEN e.metric = 'wape_difference' THEN 'negative' ELSE 'positive' END AS favorable_direction
FROM (SELECT metric, v FROM bs_long WHERE it = -1) e
JOIN (SELECT metric, quantile_cont(v, 0.025) AS ci_lower, quantile_cont(v, 0.975) AS ci_upper,
             avg(CASE WHEN metric = 'wape_difference' THEN CAST(v < 0 AS DOUBLE) ELSE CAST(v > 0 AS DOUBLE) END) AS probability_model_better
      FROM bs_long WHERE it >= 0 GROUP BY metric) s USING (metric)"""
    sql = S.with_ctes(*ctes, rows, nn, draws, wt, ranks, per, long, body=body)
    return S.round_cols(sql, ["estimate", "ci_lower", "ci_upper", "confidence", "probability_model_better"])


def _importance_sql(top=None, path="margin"):
    if path == "margin":
        m, ctes, feats, cats = MARGIN_NAMES, Q.score_ctes("margin"), MARGIN_FEATURES, MARGIN_CATEGORICAL
        value, recent, previous, smooth, clip = "margin_180d", "margin_90d", "margin_previous_90d", "10.0", "0.45"
    else:
        m, ctes, feats, cats = REVENUE_NAMES, Q.score_ctes("revenue"), REVENUE_FEATURES, REVENUE_CATEGORICAL
        value, recent, previous, smooth, clip = ("net_revenue_180d", "net_revenue_90d", "net_revenue_previous_90d",
                                                 "1.0", "0.5")
    numeric = [f for f in feats if f not in cats]
    fv = ", ".join(f"('{f}', {i})" for i, f in enumerate(feats))
    num_case = "CASE f.feature " + " ".join(f"WHEN '{c}' THEN CAST(b.{c} AS DOUBLE)" for c in numeric) + " END"
    txt_case = "CASE f.feature " + " ".join(f"WHEN '{c}' THEN CAST(b.{c} AS VARCHAR)" for c in cats) + " END"
    base = """im_base AS (SELECT *, row_number() OVER (ORDER BY customer_id, snapshot_date) AS p FROM sc_test)"""
    fe = f"im_feat AS (SELECT * FROM (VALUES {fv}) v(feature, fidx))"
    donor = f"""im_donor AS (
  SELECT f.feature, {num_case} AS dnum, {txt_case} AS dtxt,
         row_number() OVER (PARTITION BY f.feature ORDER BY
           ('0x' || substr(md5('{SEED}|' || f.feature || '|' || CAST(b.customer_id AS VARCHAR) || '|' || CAST(b.snapshot_date AS VARCHAR)), 1, 15))::BIGINT,
           b.customer_id, b.snapshot_date) AS q
  FROM im_base b CROSS JOIN im_feat f)"""

    def v(c):
        return f"CASE WHEN f.feature = '{c}' THEN d.dnum ELSE CAST(b.{c} AS DOUBLE) END"
    rec, r90, p90, v180 = v("recency_days"), v(recent), v(previous), v(value)
    change = f"least(greatest(({r90} - {p90}) / (abs({r90}) + abs({p90}) + {smooth}::DOUBLE), -{clip}::DOUBLE), {clip}::DOUBLE)"
    pred = f"round({v180} * exp(-({rec}) / 220.0::DOUBLE) * (1.0::DOUBLE + {change}), 6) + 0.0"
    shuffled = f"""im_pred AS (
  SELECT f.feature, b.{m['actual']} AS y, {pred} AS p
  FROM im_base b CROSS JOIN im_feat f JOIN im_donor d ON d.feature = f.feature AND d.q = b.p)"""
    ref = f"""im_ref AS (SELECT COALESCE(sum(abs({m['actual']} - {m['baseline']})) / NULLIF(sum(abs({m['actual']})), 0), 0.0::DOUBLE) AS r FROM sc_test)"""
    body = """SELECT feature, round(greatest(COALESCE(sum(abs(y - p)) / NULLIF(sum(abs(y)), 0), 0.0::DOUBLE) - (SELECT r FROM im_ref), 0.0::DOUBLE), 12) AS wape_increase
FROM im_pred GROUP BY feature"""
    if top:
        body = f"SELECT * FROM ({body}) z ORDER BY wape_increase DESC, feature LIMIT {int(top)}"
    return S.round_cols(S.with_ctes(*ctes, base, fe, donor, shuffled, ref, body=body), ["wape_increase"])


SQL = {
    "bootstrap_comparison": _bootstrap_sql(),
    "permutation_importance": _importance_sql(),
    "permutation_importance_revenue": _importance_sql(path="revenue"),
    "top_importance": _importance_sql(10),
}
