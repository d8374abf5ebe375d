"""End-to-end jobs: the reference's entry points as Spark jobs.

* ``ingest_job``   raw source lines -> canonical transactions + quality report (A1-A3, B*)
* ``margin_job``   orders + customers -> snapshots -> two-part model -> conformal
                   intervals -> evaluation -> policy tiers -> summaries (+ importance)
* ``revenue_job``  canonical transactions -> snapshots -> model -> evaluation ->
                   paired bootstrap -> decile summaries (+ importance)

Parameters are keyword arguments checked up front (the reference's JSON config
checks).  Row-level tables stay DataFrames; metrics are small driver dicts and a
long (section, metric, value) DataFrame.  Snapshots are materialised once,
partitioned by snapshot date, and every later stage reads them back with
partition pruning.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap as bs
from ..operators import contract as ct
from ..operators import evaluation as ev
from ..operators import importance as imp
from ..operators import integrity as ig
from ..operators import models as md
from ..operators import policy as pol
from ..operators import snapshots_margin as sm
from ..operators import snapshots_revenue as sr
from ..operators import split as sp
from ..operators.baseline import margin_baseline, revenue_baseline
from ..operators.conformal import conformal_correction
from ..operators.scoring import MARGIN_NAMES, REVENUE_NAMES
from ..session import ensure_checkpoint_dir, materialize
from ..sources import sinks

KEYS = ["customer_id", "snapshot_date"]
#: Fewest bootstrap iterations that a job accepts for its intervals.
MIN_ITERATIONS = 200


@dataclass
class JobResult:
    metrics: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def metrics_frame(self, spark: SparkSession) -> DataFrame:
        rows = []

        def walk(prefix, obj):
            if isinstance(obj, Mapping):
                for k, v in obj.items():
                    walk(f"{prefix}.{k}" if prefix else str(k), v)
            elif obj is not None:
                sec, _, name = prefix.partition(".")
                number = isinstance(obj, (int, float)) and not isinstance(obj, bool)
                rows.append((sec, name, float(obj) if number else None, None if number else str(obj)))
        walk("", self.metrics)
        return spark.createDataFrame(rows, "section string, metric string, value double, text string")


def _check_common(snapshot_dates, selection, calibration, test, lookback, horizon, target_coverage):
    dates = sorted(dt.date.fromisoformat(str(d)[:10]) for d in snapshot_dates)
    if len(dates) < 4:
        raise ValueError("at least four snapshot dates are required")
    for d in (selection, calibration, test):
        if dt.date.fromisoformat(str(d)[:10]) not in dates:
            raise ValueError(f"split date {d} is not a snapshot date")
    if int(lookback) < 1 or int(horizon) < 1:
        raise ValueError("lookback_days and horizon_days must be positive")
    if not 0.0 < float(target_coverage) < 1.0:
        raise ValueError("interval_target_coverage must lie inside (0, 1)")


def _first_row(df: DataFrame) -> dict:
    r = df.first()
    return {} if r is None else r.asDict()


def _stage(df: DataFrame, output_dir: str | None, name: str, partition_by=()) -> DataFrame:
    if output_dir:
        path = f"{output_dir.rstrip('/')}/{name}"
        sinks.write_table(df, path, partition_by=partition_by)
        return df.sparkSession.read.parquet(path)
    return materialize(df, name)


def _split_section(counts: Mapping, selection, calibration, test) -> dict:
    dates = {f"{k}_snapshot": str(v)[:10] for k, v in (("selection", selection), ("calibration", calibration), ("test", test))}
    return {f"{k}_rows": v for k, v in counts.items()} | dates


def _selection_section(chosen: Mapping, candidates: DataFrame) -> dict:
    rows = {str(r["candidate"]): {k: v for k, v in r.asDict().items() if k != "candidate"} for r in candidates.collect()}     # one row per candidate
    return {"selected_parameters": dict(chosen), "candidates": rows}


def _data_section(transactions: DataFrame, quality: DataFrame | None, snapshot_dates, lookback_days: int) -> dict:
    """Audit of the transactions, of their source if its report is given, and how far back they reach at each date."""
    own = _first_row(ct.canonical_quality(transactions))
    source = _first_row(quality) if quality is not None else {}
    if source:
        own.update({k: source[k] for k in ("source_rows", "exact_duplicate_rows", "missing_customer_rows", "excluded_rows") if k in source})
        own["other_invalid_rows_excluded"] = source["excluded_rows"] - source["missing_customer_rows"]
    reach = {r["snapshot_date"].isoformat(): r for r in ct.lookback_coverage(transactions, snapshot_dates, lookback_days).collect()}     # one row per date
    own["lookback_coverage"] = {"required_days": int(lookback_days), "minimum_available_days": min(r["available_days"] for r in reach.values()),
                                "all_snapshots_complete": all(r["complete"] for r in reach.values()),
                                "available_days_by_snapshot": {d: r["available_days"] for d, r in reach.items()}}
    return own


def _model_stage(snapshots: DataFrame, names, categorical, numeric, selection, calibration, test,
                 candidates, rounds, target_coverage, output_dir):
    roles = sp.with_role(snapshots, selection, calibration, test)
    split_counts = sp.check_split(roles)
    train, sel = sp.part(roles, "train"), sp.part(roles, "selection")
    chosen, cand_table = md.select_candidate(train, sel, categorical, numeric, names["actual"], names["active"],
                                             candidates, rounds)
    model = md.fit_two_part(sp.part(roles, "train", "selection"), categorical, numeric, names["actual"],
                            names["active"], chosen, rounds)
    cal_pred = _stage(md.predict(model, sp.part(roles, "calibration"), names), output_dir, "calibration_scores")
    calib = _first_row(conformal_correction(cal_pred, names["actual"], names["lower_raw"], names["upper_raw"],
                                            KEYS, target_coverage))
    test_frame = sp.part(roles, "test")
    pred = md.predict(model, test_frame, names, float(calib["correction"]))
    return roles, split_counts, chosen, cand_table, model, calib, test_frame, pred


def _evaluate(scored: DataFrame, names) -> dict:
    yr = ev.value_ranks(scored, names["actual"], KEYS, "_ry")
    model = _first_row(ev.regression_metrics(scored, names["actual"], names["pred"], KEYS, names["lower"],
                                             names["upper"], yr))
    raw = _first_row(ev.interval_coverage(scored, names["actual"], names["lower_raw"], names["upper_raw"], "raw"))
    model["interval_80_raw_coverage"] = raw["raw_80_coverage"]
    model["interval_raw_mean_width"] = raw["raw_mean_width"]
    model.update(_first_row(ev.average_precision(scored, names["active"], names["prob"])))
    model.update(_first_row(ev.brier(scored, names["active"], names["prob"])))
    model.update(_first_row(ev.portfolio_checks(scored, names["actual"], names["pred"])))
    base = _first_row(ev.regression_metrics(scored, names["actual"], names["baseline"], KEYS, actual_ranks=yr))
    return {"model": model, "baseline": base}


def _importance(model, test_frame, names, features, categorical, seed):
    def scorer(frame):
        rows = model.preprocessor.transform(frame)
        return md.point_prediction(model.classifier, model.regressor, rows, "prediction", names["prob"])
    cols = [*KEYS, names["actual"], *features]
    return imp.permutation_importance(test_frame.select(*cols), features, categorical, names["actual"], scorer,
                                      KEYS, seed)


def margin_job(spark: SparkSession, orders: DataFrame, customers: DataFrame, *, snapshot_dates: Sequence,
               selection: str, calibration: str, test: str, lookback_days: int = 365, horizon_days: int = 180,
               annual_discount_rate: float = 0.10, interval_target_coverage: float = 0.80,
               policy: Mapping = pol.DEFAULT_POLICY, rounds: int = md.MAX_ITER,
               seed: int = 42, with_importance: bool = True, output_dir: str | None = None) -> JobResult:
    _check_common(snapshot_dates, selection, calibration, test, lookback_days, horizon_days, interval_target_coverage)
    pol.check_policy(policy)
    ensure_checkpoint_dir(spark)
    names = MARGIN_NAMES
    sizes = {"customers": customers.count(), "orders": orders.count()}
    snaps = sm.margin_snapshots(customers, orders, snapshot_dates, lookback_days, horizon_days, annual_discount_rate)
    snaps = _stage(snaps, output_dir, "customer_snapshots", ["snapshot_date"])
    ct.validate_snapshots(snaps, snapshot_dates)
    fp = _first_row(ig.fingerprint(snaps))
    roles, counts, chosen, cand, model, calib, test_frame, pred = _model_stage(
        snaps, names, sm.MARGIN_CATEGORICAL, sm.MARGIN_NUMERIC, selection, calibration, test,
        md.MARGIN_CANDIDATES, rounds, interval_target_coverage, output_dir)
    scored = pred.withColumn(names["baseline"], margin_baseline())
    scored = _stage(scored, output_dir, "test_predictions")
    evaluation = _evaluate(scored, names)
    decided = pol.apply_policy(scored, policy, names["pred"], names["lower"], names["upper"], ["snapshot_date", "customer_id"])
    decided = pol.add_flags(decided, policy, names["pred"], names["lower_raw"], names["upper_raw"], "_raw")
    decided = ev.assign_deciles(decided, names["pred"], KEYS)
    decided = _stage(decided, output_dir, "holdout_customer_scores")
    tiers = pol.policy_summary(decided, names["pred"], names["actual"])
    by_decile = ev.interval_diagnostics(decided, "predicted_value_decile", names["actual"], names["lower_raw"],
                                        names["upper_raw"], names["lower"], names["upper"])
    by_tier = ev.interval_diagnostics(decided, "service_tier", names["actual"], names["lower_raw"],
                                      names["upper_raw"], names["lower"], names["upper"])
    impact = _first_row(pol.policy_impact(decided))
    protect = {r["service_tier"]: r for r in tiers.collect()}["protect"]
    tables = {"snapshots": snaps, "scored": decided, "tier_summary": tiers, "interval_by_decile": by_decile,
              "interval_by_tier": by_tier, "candidates": cand}
    if with_importance:
        tables["importance"] = _stage(_importance(model, test_frame, names, sm.MARGIN_FEATURES, sm.MARGIN_CATEGORICAL, seed), None, "importance")
    metrics = {
        "data": {**sizes, "snapshot_rows": fp["rows"], "fingerprint": fp["fingerprint"]},
        "split": _split_section(counts, selection, calibration, test),
        "model_selection": _selection_section(chosen, cand),
        "holdout": evaluation,
        "interval_calibration": {**calib, **impact},
        "decision_evidence": {
            "relative_wape_reduction_vs_baseline":
                1.0 - evaluation["model"]["wape"] / evaluation["baseline"]["wape"] if evaluation["baseline"]["wape"] else None,
            "protect_tier_realized_value_share": protect["realized_value_share"],
            "protect_tier_customer_share": protect["customer_share"],
        },
    }
    result = JobResult(metrics, tables)
    if output_dir:
        _save_model(spark, model, output_dir, sm.MARGIN_FEATURES, metrics["interval_calibration"], fp["fingerprint"])
        _write_outputs(result, output_dir, {"model_type": "activity and conditional value, histogram boosting",
                                            "target": "discounted margin in the horizon, with its sign",
                                            "features": sm.MARGIN_FEATURES, "selected_parameters": chosen,
                                            "interval_calibration": metrics["interval_calibration"], "data_fingerprint": fp["fingerprint"]})
    return result


def revenue_job(spark: SparkSession, transactions: DataFrame, *, snapshot_dates: Sequence, selection: str,
                calibration: str, test: str, lookback_days: int = 365, horizon_days: int = 180,
                interval_target_coverage: float = 0.80, bootstrap_iterations: int = 1000, rounds: int = md.MAX_ITER,
                seed: int = 42, with_importance: bool = True, quality: DataFrame | None = None,
                output_dir: str | None = None) -> JobResult:
    """``quality`` is the one-row report of ``ingest_job``; with it the data section has the source's counters too."""
    _check_common(snapshot_dates, selection, calibration, test, lookback_days, horizon_days, interval_target_coverage)
    if int(bootstrap_iterations) < MIN_ITERATIONS:
        raise ValueError(f"bootstrap_iterations must be at least {MIN_ITERATIONS}")
    ensure_checkpoint_dir(spark)
    names = REVENUE_NAMES
    ct.lookback_gate(transactions, snapshot_dates, lookback_days)
    snaps = sr.revenue_snapshots(transactions, snapshot_dates, lookback_days, horizon_days)
    snaps = _stage(snaps, output_dir, "customer_snapshots", ["snapshot_date"])
    ct.validate_snapshots(snaps, snapshot_dates, binary_col=sr.REVENUE_ACTIVE)
    fp = _first_row(ig.fingerprint(snaps))
    roles, counts, chosen, cand, model, calib, test_frame, pred = _model_stage(
        snaps, names, sr.REVENUE_CATEGORICAL, sr.REVENUE_NUMERIC, selection, calibration, test,
        md.REVENUE_CANDIDATES, rounds, interval_target_coverage, output_dir)
    scored = pred.withColumn(names["baseline"], revenue_baseline())
    scored = _stage(ev.assign_deciles(scored, names["pred"], KEYS), output_dir, "test_predictions")
    evaluation = _evaluate(scored, names)
    boot = _stage(bs.paired_bootstrap(scored, names["actual"], names["pred"], names["baseline"], KEYS,
                                      bootstrap_iterations, seed), None, "bootstrap")      # four rows, used three times
    deciles = ev.decile_value_summary(scored, "predicted_value_decile", names["actual"], names["pred"])
    by_decile = ev.interval_diagnostics(scored, "predicted_value_decile", names["actual"], names["lower_raw"],
                                        names["upper_raw"], names["lower"], names["upper"])
    top = {r["predicted_value_decile"]: r for r in by_decile.collect()}.get(10)
    tables = {"snapshots": snaps, "value_by_decile": deciles, "interval_by_decile": by_decile,
              "bootstrap": boot, "candidates": cand}
    if with_importance:
        tables["importance"] = _stage(_importance(model, test_frame, names, sr.REVENUE_FEATURES, sr.REVENUE_CATEGORICAL, seed), None, "importance")
    metrics = {
        "data": {**_data_section(transactions, quality, snapshot_dates, lookback_days), "snapshot_rows": fp["rows"], "snapshot_fingerprint": fp["fingerprint"]},
        "split": _split_section(counts, selection, calibration, test),
        "model_selection": _selection_section(chosen, cand),
        "holdout": evaluation,
        "bootstrap_comparison": {"iterations": int(bootstrap_iterations), "method": "customers drawn with replacement, the same draws for model and baseline",
                                 "metrics": {r["metric"]: {k: v for k, v in r.asDict().items() if k != "metric"} for r in boot.collect()}},
        "decision_evidence": {f"{who}_top_{p}_value_capture": evaluation[who][f"top_{p}_value_capture"] for p in (10, 20) for who in ("model", "baseline")},
        "publication_guardrail": {"row_level_output_published": False, "target": "signed net revenue in the horizon",
                                  "not_available": "contribution margin, cost of treatment, causal effect"},
        "interval_calibration": calib,
        "conditional_interval": {
            "highest_value_decile_coverage": top["calibrated_coverage"] if top else None,
            "highest_value_decile_mean_width": top["calibrated_mean_width"] if top else None,
        },
    }
    result = JobResult(metrics, tables)
    if output_dir:
        published = {k: v for k, v in tables.items() if k in ("value_by_decile", "interval_by_decile", "bootstrap", "importance")}
        for k, v in published.items():
            sinks.publish_aggregates(v, f"{output_dir.rstrip('/')}/public/{k}")
        _save_model(spark, model, output_dir, sr.REVENUE_FEATURES, calib, fp["fingerprint"])
        _write_outputs(result, output_dir, None)
    return result


def ingest_job(spark: SparkSession, raw: DataFrame, output_path: str | None = None, fmt: str = "parquet",
               quality_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw lines -> (canonical transactions, one-row quality report).

    ``output_path`` writes the canonical table (Parquet by invoice month, or gzip CSV
    with second-precision timestamps) and reads it back typed; ``quality_path``
    writes the quality report as JSON.
    """
    from ..sources.raw import read_canonical
    canonical = ct.canonicalize(raw)
    if output_path:
        sinks.write_canonical(canonical, output_path, fmt=fmt)
        canonical = read_canonical(spark, output_path, fmt=fmt)
    report = ct.quality_report(raw, canonical).crossJoin(
        ct.rows_per_source(raw).agg(F.map_from_entries(F.collect_list(F.struct("source_sheet", "rows")))
                                    .alias("source_sheets")))     # one entry per source
    if quality_path:
        sinks.write_metrics(report, quality_path)
    return canonical, report


def _save_model(spark: SparkSession, model: md.TwoPartModel, output_dir: str, features, calibration: Mapping, fingerprint: str) -> None:
    """the fitted model as a new version below ``model``, with what it was calibrated and fitted on."""
    model.facts = {"features": list(features), "interval_calibration": dict(calibration), "data_fingerprint": fingerprint}
    model.save(spark, f"{output_dir.rstrip('/')}/model")


def _write_outputs(result: JobResult, output_dir: str, metadata: dict | None) -> None:
    base = output_dir.rstrip("/")
    for name, df in result.tables.items():
        if name in ("snapshots",):
            continue
        small = name not in ("scored",)
        sinks.write_table(df, f"{base}/tables/{name}", fmt="parquet", small=small)
    spark = next(iter(result.tables.values())).sparkSession
    sinks.write_metrics(result.metrics_frame(spark), f"{base}/metrics")
    sinks.write_json_file(spark, result.metrics, f"{base}/metrics.json")       # nested, sorted keys
    if metadata is not None:
        sinks.write_json_file(spark, metadata, f"{base}/model_metadata.json")
