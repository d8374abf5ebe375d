"""Throughput benchmark: headline queries on the supplied tables.

Runs each query end to end (full computation via the no-op sink, nothing
collected) at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "margin_snapshots",          # one-pass as-of features + labels, all dates
    "revenue_snapshots",         # one-pass as-of revenue snapshots incl. whole-history eligibility
    "canonical_transactions",    # raw lines -> canonical contract + dedup
    "quality_report",            # source and post-cleaning counters
    "fingerprint_revenue",       # order-free table fingerprint
    "full_evaluation",           # metrics incl. global-rank Spearman / capture / AP
    "policy_summary",            # conformal + tiers + per-tier summary (flagship)
    "capture_curve",             # distributed prefix sums
    "permutation_importance",    # features x rows scoring pass
    "bootstrap_comparison",      # 1000-iteration paired bootstrap
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    from valuelens.plans import registry
    from valuelens.session import build_session, cleanup_materialized
    spark = build_session(master=f"local[{cpus}]", app="valuelens-bench", shuffle_partitions=max(8, cpus),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = registry.queries()
    # warm-up: JVM, parquet footers, codegen caches
    qs["margin_orders"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float | None] = {}
    failed: list[str] = []
    for name in names:
        t0 = time.perf_counter()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # noqa: BLE001 - report and keep measuring the others
            times[name] = None
            failed.append(name)
            print(f"# {name} failed: {type(exc).__name__}: {str(exc)[:300]}", file=sys.stderr)
            continue
        print(f"# {name}: {times[name]:.2f}s", file=sys.stderr)
        cleanup_materialized(spark)
    sf = os.path.basename(sf_dir).replace("sf", "")
    total = round(sum(v for v in times.values() if v is not None), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
                      "cpus": cpus, "failed": failed}))
    spark.stop()


if __name__ == "__main__":
    main()
