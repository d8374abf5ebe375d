"""Cut points by distributed selection, against a sorted list."""

import math

import pytest
from pyspark.sql import functions as F

from valuelens.operators import conformal, evaluation as ev, policy as pol
from valuelens.operators import selection
from valuelens.operators.selection import find_cuts

VALUES = [0.0, -0.0, 1.5, -2.25, 1e300, -1e-300, float("inf"), float("-inf"), 0.1, 3.0]


def _frame(spark, n):
    rows = [(VALUES[(i * 7) % len(VALUES)] if i % 3 else float(i % 11), f"k{i:04d}'\\é") for i in range(n)]
    return spark.createDataFrame(rows, "v double, k string").repartition(5), rows


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("pivots", [1, 3, 50, 1023])
def test_places_equal_those_of_a_sorted_list(spark, descending, pivots):
    n = 14 if pivots == 1 else 300
    df, rows = _frame(spark, n)
    ranks = [1, 2, n // 3, n // 3, n // 2, n]
    cuts = find_cuts(df, "v", ["k"], lambda count: ranks, descending, pivots, min(pivots + 1, 400))
    ordered = sorted(rows, key=lambda r: ((-r[0] if descending else r[0]) + 0.0, r[1]))
    assert cuts.n == n and cuts.scores(descending) == [ordered[r - 1][0] for r in ranks]
    got = {r["k"]: r["p"] for r in df.select("k", cuts.place().alias("p")).collect()}
    assert got == {row[1]: sum(r < i + 1 for r in ranks) for i, row in enumerate(ordered)}


def test_nulls_and_nan_keep_the_place_of_order_by(spark):
    rows = [(None, 1), (float("nan"), 2), (1.0, 3), (float("inf"), 4), (None, 5), (-1.0, None), (-1.0, 6)]
    df = spark.createDataFrame(rows, "v double, k int")
    for descending in (False, True):
        order = F.col("v").desc() if descending else F.col("v").asc()
        expected = [r["k"] for r in df.orderBy(order, "k").collect()]
        cuts = find_cuts(df, "v", ["k"], lambda n: list(range(1, n + 1)), descending, 2, 3)
        got = {r["p"]: r["k"] for r in df.select("k", cuts.place().alias("p")).collect()}
        assert [got[i] for i in range(len(rows))] == expected


def test_equal_rows_leave_together_and_the_search_ends(spark):
    df = spark.range(0, 50).select(F.lit(2.0).alias("v"), F.lit("same").alias("k"))
    cuts = find_cuts(df, "v", ["k"], lambda n: [1, n // 2, n], pivots=1, sample_rows=2)
    assert cuts.scores() == [2.0] * 3
    assert df.select(cuts.place().alias("p")).distinct().collect() == [(0,)]


def test_empty_frame_and_bad_ranks(spark):
    df = spark.createDataFrame([], "v double, k long")
    assert find_cuts(df, "v", ["k"], lambda n: [1]).rows == []
    assert ev.assign_deciles(df, "v", ["k"]).collect() == []
    assert ev.top_capture(df, "v", "v", ["k"]).first()[0] == 0.0
    got = conformal.conformal_correction(df.selectExpr("v AS y", "v AS lo", "v AS hi", "k"), "y", "lo", "hi", ["k"]).first()
    assert got["correction"] is None and got["calibration_rows"] == 0
    one = spark.createDataFrame([(1.0, 1)], "v double, k long")
    for ranks in ([0], [2], [1, 0]):
        with pytest.raises(ValueError):
            find_cuts(one, "v", ["k"], lambda n: ranks)


def test_one_hot_value_and_a_typed_key(spark):
    """Two thirds of the rows share a score; date and decimal keys come back exactly."""
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"),
        F.expr("date_add(DATE'2020-01-01', CAST(id AS INT))").alias("d"), (F.col("id") / 7).cast("decimal(12,4)").alias("x"))
    cuts = find_cuts(df, "v", ["d", "x"], lambda n: [n // 4, n // 2], pivots=15, sample_rows=64)
    sizes = dict(df.groupBy(cuts.place().alias("p")).count().collect())
    assert sizes == {0: 750, 1: 750, 2: 1500}


@pytest.mark.parametrize("descending", [False, True])
def test_rows_of_few_bins_are_told_by_the_bins_ends(spark, descending):
    """As ``place`` tells them, in every bin and for nulls, NaN, zeros and texts; no search in the plan."""
    rows = [(None, "a"), (float("nan"), "b"), (-0.0, "c"), (0.0, None), (1.5, "d'\\é"), (1.5, "e"), (float("inf"), "f"), (-3.0, "g")]
    df = spark.createDataFrame(rows * 2, "v double, k string")
    sort = selection._sort_columns("v", ["k"], descending)
    parts = df.select(*[c.alias(f"c{i}") for i, c in enumerate(sort)])
    types, row = [f.dataType.simpleString() for f in parts.schema.fields], F.struct(*parts.columns)
    texts = [F.col(c).cast("string").alias(c) for c in parts.columns]
    drawn = [tuple(r) for r in parts.distinct().orderBy(*parts.columns).select(*texts).collect()]
    pivots = [drawn[i] for i in (1, 3, 6)]
    upto = selection._at_most(selection._literal(pivots, types), len(pivots), row)
    on = F.coalesce(F.get(selection._literal(pivots, types), upto - 1) == row, F.lit(False))
    place = F.when(on, 2 * upto - 1).otherwise(2 * upto)
    for bins in ([0], [2], [4], [6], [0, 4], [0, 2, 4, 6]):
        told = parts.where(selection._between(bins, pivots, types, row))
        assert sorted(map(str, told.collect())) == sorted(map(str, parts.where(place.isin(bins)).collect()))
        assert "aggregate(" not in told._jdf.queryExecution().executedPlan().toString()


def test_cut_point_operators_move_no_rows(spark):
    """No range exchange and no join in the plans of deciles, tiers, capture and curve."""
    df = spark.range(0, 200).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("p"),
                                    (F.col("id") * 2.0).alias("y"))
    bounds = df.withColumn("lo", F.col("p") - 1).withColumn("hi", F.col("p") + 1)
    plans = [ev.assign_deciles(df, "p", ["k"]), ev.top_capture(df, "y", "p", ["k"]),
             pol.apply_policy(bounds, pol.DEFAULT_POLICY, "p", "lo", "hi", ["k"]),
             conformal.conformal_correction(bounds, "y", "lo", "hi", ["k"])]
    for out in plans:
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in text and "Join" not in text
    for out in plans[::2]:
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_tiers_without_capacity(spark):
    rows = [(i, float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "k long, p double").withColumn("lo", F.col("p")).withColumn("hi", F.col("p"))
    shares = {"protect": 0.0, "grow": 0.5, "nurture": 0.0, "low_touch": 0.5}
    out = pol.apply_policy(df, dict(pol.DEFAULT_POLICY, tier_shares=shares), "p", "lo", "hi", ["k"])
    assert {r["k"]: r["service_tier"] for r in out.collect()} == {i: "grow" if i > 2 else "low_touch" for i in range(6)}


@pytest.mark.parametrize("n", [1, 2, 9, 100, 137])
def test_curve_equals_a_sorted_list(spark, n):
    rows = [(i, float((i * 13) % 10), float(i % 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, p double, y double")
    got = {r["coverage_point"]: r["customers"] for r in ev.capture_curve(df, "y", "p", ["k"], 20).collect()}
    assert got == {p: sum(math.floor(20 * r / n) + 1 <= p for r in range(n)) for p in range(1, 21)}
