"""End-to-end jobs on the supplied sf0.001 tables, checked by invariants
(model parity with the reference is not a goal)."""

import math
import os

import pytest
from pyspark.sql import functions as F

from valuelens.operators.policy import TIER_ORDER
from valuelens.plans import jobs
from valuelens.plans.common import MARGIN_DATES, REVENUE_DATES
from valuelens.sources import tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="supplied tables not present")


def test_margin_job_invariants(spark, tmp_path):
    orders = tables.orders_fixture(spark, SF)
    customers = tables.customers_fixture(spark, SF, orders)
    r = jobs.margin_job(spark, orders, customers, snapshot_dates=MARGIN_DATES, selection="1998-06-30",
                        calibration="1999-06-30", test="2000-06-30", rounds=4,
                        with_importance=True, output_dir=str(tmp_path / "out"))
    m = r.metrics
    assert set(m) >= {"data", "split", "model_selection", "holdout", "interval_calibration", "decision_evidence"}
    assert m["interval_calibration"]["calibrated_coverage"] >= 0.8 - 1e-12
    assert m["interval_calibration"]["correction"] >= 0.0
    scored = r.tables["scored"]
    bad = scored.filter((F.col("clv_lower_80") > F.col("predicted_clv_180d")) |
                        (F.col("predicted_clv_180d") > F.col("clv_upper_80")) |
                        (F.col("clv_lower_80") > F.col("clv_lower_80_raw")) |
                        F.isnan("predicted_clv_180d")).count()
    assert bad == 0
    p = scored.agg(F.min("active_probability_180d"), F.max("active_probability_180d")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0
    tiers = {row["service_tier"]: row for row in r.tables["tier_summary"].collect()}
    assert list(tiers) and set(tiers) == set(TIER_ORDER)
    n = scored.count()
    assert tiers["protect"]["customers"] == math.floor(n * 0.1) or tiers["protect"]["customers"] == math.ceil(n * 0.1)
    imp = r.tables["importance"].collect()
    assert len(imp) == 22 and all(row["wape_increase"] >= 0 for row in imp)
    assert os.path.exists(tmp_path / "out" / "model_metadata.json")
    import json
    doc = json.loads((tmp_path / "out" / "metrics.json").read_text())
    assert list(doc) == sorted(doc) and "holdout" in doc
    assert spark.read.json(str(tmp_path / "out" / "metrics")).count() > 20
    assert m["data"]["orders"] == orders.count() and m["split"]["selection_snapshot"] == "1998-06-30"
    assert [c["chosen"] for c in m["model_selection"]["candidates"].values()].count(True) == 1
    # the stored model scores as the fitted one did, and an unfinished version is not loaded
    from valuelens.operators import models as md
    from valuelens.operators.scoring import MARGIN_NAMES as N
    folder = str(tmp_path / "out" / "model")
    os.makedirs(tmp_path / "out" / "model" / "v7")
    model = md.TwoPartModel.load(spark, folder)
    assert model.facts["data_fingerprint"] == m["data"]["fingerprint"] and len(model.classifier.trees) == 4
    test = r.tables["snapshots"].where("snapshot_date = DATE '2000-06-30'")
    again = md.predict(model, test, N, model.facts["interval_calibration"]["correction"])
    cols = [N["pred"], N["prob"], N["lower"], N["upper"], N["lower_raw"], N["upper_raw"]]
    both = again.select("customer_id", *cols).exceptAll(scored.select("customer_id", *cols))
    assert again.count() == n and both.count() == 0
    assert model.save(spark, folder).endswith("/v8")
    with pytest.raises(FileNotFoundError):
        md.TwoPartModel.load(spark, folder, version=7)


def test_first_minimum_wins():
    from valuelens.operators.models import first_minimum
    assert first_minimum([0.5, 0.3, 0.3]) == 1 and first_minimum([0.3, 0.3, 0.1]) == 2 and first_minimum([0.2]) == 0


def test_revenue_job_invariants(spark):
    tx = tables.transactions_fixture(spark, SF)
    r = jobs.revenue_job(spark, tx, snapshot_dates=REVENUE_DATES, selection="1998-07-01",
                         calibration="1999-07-01", test="2000-07-01", bootstrap_iterations=200, rounds=4,
                         with_importance=False)
    m = r.metrics
    assert m["interval_calibration"]["calibrated_coverage"] >= 0.8 - 1e-12
    assert m["bootstrap_comparison"]["iterations"] == 200 and m["data"]["lookback_coverage"]["all_snapshots_complete"]
    assert m["data"]["usable_rows"] == tx.count() and m["split"]["test_snapshot"] == "2000-07-01"
    assert set(m["decision_evidence"]) == {f"{w}_top_{p}_value_capture" for w in ("model", "baseline") for p in (10, 20)}
    boot = m["bootstrap_comparison"]["metrics"]
    assert set(boot) == {"wape_difference", "spearman_difference", "top_10_capture_difference",
                         "top_20_capture_difference"}
    for v in boot.values():
        assert v["ci_lower"] <= v["ci_upper"]
    deciles = r.tables["value_by_decile"].collect()
    assert sorted(row["predicted_value_decile"] for row in deciles) == list(range(1, 11))
    assert abs(sum(row["realized_value_share"] for row in deciles) - 1.0) < 1e-9


def test_ingest_job_quality(spark, tmp_path):
    raw = tables.raw_lines_fixture(spark, SF)
    canonical, report = jobs.ingest_job(spark, raw, str(tmp_path / "canon"), fmt="csv",
                                        quality_path=str(tmp_path / "quality"))
    assert spark.read.json(str(tmp_path / "quality")).first()["usable_rows"] == canonical.count()
    q = report.first()
    assert q["usable_rows"] == canonical.count()
    assert q["excluded_rows"] == q["source_rows"] - q["usable_rows"]
    assert set(q["source_sheets"]) == {"early", "late"}


def test_nulls_first_seen_at_scoring_take_the_median(spark):
    from valuelens.operators.preprocess import numeric_medians, preprocess
    fit = spark.createDataFrame([("a", 1, "x", 1.0, None), ("b", 1, "x", 3.0, None)], "customer_id string, snapshot_date int, c string, v double, w double")
    new = spark.createDataFrame([("z", 2, "x", None, None)], fit.schema)
    row = preprocess(fit, new, ["c"], ["v", "w"]).first()
    assert row["v"] == 2.0 and row["w"] is None and numeric_medians(fit, ["v", "w"]) == {"v": 2.0}
