"""Bootstrap determinism and weighted statistics; permutation importance."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from valuelens.functions.columns import hash_index
from valuelens.operators import bootstrap as bs
from valuelens.operators import importance as imp


def _frame(spark):
    y = np.arange(1, 41, dtype=float)
    model = y + 0.1 * np.sin(y)
    base = y[::-1].copy()
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, model, base))],
                                 "k long, y double, m double, b double")


def test_bootstrap_is_repeatable_and_sane(spark):
    df = _frame(spark)
    a = {r["metric"]: r for r in bs.paired_bootstrap(df, "y", "m", "b", ["k"], iterations=50, seed=7).collect()}
    b = {r["metric"]: r for r in bs.paired_bootstrap(df.repartition(3), "y", "m", "b", ["k"], 50, 7).collect()}
    assert a.keys() == set(bs.METRICS)
    for m in a:
        assert a[m]["ci_lower"] == pytest.approx(b[m]["ci_lower"])
        assert a[m]["ci_lower"] <= a[m]["ci_upper"]
    assert a["spearman_difference"]["estimate"] > 1.5          # model ~ +1, reversed baseline ~ -1
    assert a["wape_difference"]["favorable_direction"] == "negative"
    assert a["wape_difference"]["probability_model_better"] == 1.0


def test_bootstrap_matches_numpy_weighted_resamples(spark):
    """Recompute every iteration with NumPy from the same hashed draws."""
    df = _frame(spark)
    n, B, seed = 40, 30, 11
    got = {r["metric"]: r for r in bs.paired_bootstrap(df, "y", "m", "b", ["k"], B, seed, draw_hash="md5").collect()}
    draws = spark.range(0, B * n).select(F.expr(f"id div {n}").alias("it"), (F.col("id") % n).alias("d")) \
        .select("it", (F.pmod(hash_index(F.lit(seed), "it", "d"), F.lit(n))).alias("idx")).collect()
    y = np.arange(1, 41, dtype=float)
    m, b = y + 0.1 * np.sin(y), y[::-1].copy()
    per = {}
    for r in draws:
        per.setdefault(r["it"], []).append(r["idx"])

    def cap(a, s, f):
        k = max(1, int(np.ceil(len(a) * f)))
        order = np.lexsort((np.arange(len(s)), -s))[:k]
        return a[order].sum() / a.sum()

    diffs = []
    for it in range(B):
        idx = np.sort(np.array(per[it]))
        ya, ma, ba = y[idx], m[idx], b[idx]
        sp = np.corrcoef(pd.Series(ya).rank(), pd.Series(ma).rank())[0, 1] - \
            np.corrcoef(pd.Series(ya).rank(), pd.Series(ba).rank())[0, 1]
        diffs.append((sp, cap(ya, ma, 0.1) - cap(ya, ba, 0.1)))
    sp = np.array([d[0] for d in diffs])
    t10 = np.array([d[1] for d in diffs])
    assert got["spearman_difference"]["ci_lower"] == pytest.approx(np.quantile(sp, 0.025))
    assert got["top_10_capture_difference"]["ci_upper"] == pytest.approx(np.quantile(t10, 0.975))


def test_permutation_importance_detects_used_feature(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(z), "a" if i % 2 else "b", float(3 * x + 1)) for i, (x, z) in
            enumerate(zip(rng.normal(size=200), rng.normal(size=200)))]
    df = spark.createDataFrame(rows, "k long, x double, z double, c string, y double")
    out = {r["feature"]: r["wape_increase"] for r in imp.permutation_importance(
        df, ["c", "x", "z"], ["c"], "y", imp.expression_scorer(F.col("x") * 3 + 1), ["k"], seed=5).collect()}
    assert out["x"] > 0.5 and out["z"] == 0.0 and out["c"] == 0.0


def test_bootstrap_blocked_path_equals_single_block_path(spark):
    df = _frame(spark)
    one = {r["metric"]: r for r in bs.paired_bootstrap(df, "y", "m", "b", ["k"], 20, 3).collect()}
    blocked = {r["metric"]: r for r in bs.paired_bootstrap(df, "y", "m", "b", ["k"], 20, 3, block_rows=7).collect()}
    for m in one:
        for f in ("estimate", "ci_lower", "ci_upper", "probability_model_better"):
            assert one[m][f] == pytest.approx(blocked[m][f], abs=1e-12)


def test_draws_and_ranks_move_packed(spark):
    """A task sends a row for an iteration and block, not for each draw; ranks take two bytes beside the first, or four where they must."""
    draws = spark.range(0, 3000, numPartitions=2).selectExpr("cast(id div 1000 AS int) AS it", "(id * 7919) % 1000 AS _row")
    got = bs._packed_draws(draws, 100).collect()
    assert len(got) <= 4 * 10
    rows = sorted((r["it"], r["_blk"] * 100 + int(o)) for r in got for o in np.frombuffer(r["offs"], "<u2"))
    assert rows == sorted((r["it"], r["_row"]) for r in draws.collect())
    far = np.array([[5, 6, -32000], [2**33, 2**33 + 32767, 2**33 - 32767], [0, 40_000, -1]], np.int64)
    packed = bs._packed_distances(far, "<i4")
    assert [len(x.as_py()) for x in packed] == [12, 12, 16]
    assert (bs._distances(pa.chunked_array([packed]), 3, "<i4") == far).all()
    w = pa.chunked_array([pa.array([np.array([1, 300], "<u2").tobytes()])]), pa.chunked_array([pa.array([bytes([1, 255])])])
    assert [bs._weights(x, 2).tolist() for x in w] == [[[1, 300]], [[1, 255]]]


def test_what_the_bootstrap_moves_is_squeezed(spark):
    """Multiplicities take a few bits each, a run's offsets half a byte, distances less than two bytes; all come back as they were."""
    rng = np.random.default_rng(2)
    n, b, block = 400, 600, 100
    picked = rng.integers(0, n, (b, n))
    draws = spark.createDataFrame(pd.DataFrame({"it": np.repeat(np.arange(b), n).astype(np.int32), "_row": picked.ravel()})).repartition(2)
    rows = spark.range(1, n + 1).selectExpr("id AS _rid", "CAST(id AS DOUBLE) AS y")
    got = bs._multiplicities(rows, draws, b, block).orderBy("y").toArrow()
    want = np.stack([np.bincount(x, minlength=n) for x in picked], 1)
    weights = bs._weights(got["w"], b + 1)
    assert (weights[:, 0] == 1).all() and (weights[:, 1:] == want).all()
    assert np.mean([len(x) for x in got["w"].to_pylist()]) < 0.45 * (b + 1)
    runs = bs._packed_draws(draws, 1000, squeezed=True).collect()
    assert sum(len(r["offs"]) for r in runs) < 0.8 * n * b and sorted(x for r in runs for x in bs._whole_run(r["offs"])) == sorted(picked.ravel())
    assert bs._whole_run(bs._squeezed_run(np.array([0, 70_000, 70_000], "<u4"))).tolist() == [0, 70_000, 70_000]
    far = np.concatenate([np.full((50, 1), 2**33), 2**33 + (rng.normal(size=(50, b)) * 1000).astype(np.int64)], 1)
    far[0, 5] = 2**33 + 40_000
    cells = bs._squeezed_distances(bs._packed_distances(far, "<i4"), b + 1)
    assert (bs._distances(pa.chunked_array([cells]), b + 1, "<i4") == far).all()
    assert len(cells[0].as_py()) == 8 + 4 * b and max(len(x.as_py()) for x in cells[1:]) < 8 + 1.85 * b
    often = np.ones((2, b + 1), "<u2")
    often[1, 3] = 300
    cells = bs._squeezed([often[0].astype("u1").tobytes(), often[1].tobytes()], b + 1)
    assert (bs._weights(pa.chunked_array([cells]), b + 1) == often).all()
