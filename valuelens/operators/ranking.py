"""Scale-safe global ordering primitives.

``row_number()`` over an un-partitioned window plans ``Exchange SinglePartition``:
every row goes through one task.  Here a global order is built from a range
partitioning instead:

1. ``repartitionByRange(P, order..., key...)`` splits the rows into P ordered,
   balanced ranges (ties on the score are split by the unique key), then
   ``sortWithinPartitions`` orders each range;
2. ``monotonically_increasing_id`` numbers the rows (partition id in the high
   bits, position inside the partition in the low 33 bits) and the frame is
   materialised under the shared checkpoint folder so the ids are fixed;
3. P per-range counts (a P-row aggregate, broadcast because P is a parameter)
   give each range its offset; rank = offset + position + 1.

Everything downstream (deciles, top-k capture, tiers, order statistics,
average ranks, prefix sums) is expressed on that rank with ordinary
aggregations and equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_parallelism, materialize

_LOW_BITS = (1 << 33) - 1


def _as_sort(c: str | Column) -> Column:
    return F.col(c).asc() if isinstance(c, str) else c


def global_rank(df: DataFrame, order: Sequence[str | Column], rank_col: str = "rank",
                partitions: int | None = None, keep_range: str | None = None) -> DataFrame:
    """Add a dense 1..n ``rank_col`` following ``order`` (must end in a unique key).

    ``keep_range`` names a column for the range (0..P-1) that holds the row.
    """
    spark = df.sparkSession
    p = int(partitions or default_parallelism(spark))
    sort = [_as_sort(c) for c in order]
    ordered = (df.repartitionByRange(p, *sort).sortWithinPartitions(*sort)
               .withColumn("_mid", F.monotonically_increasing_id()))
    fixed = materialize(ordered, "rank")
    fixed = fixed.withColumn("_pid", F.shiftright("_mid", 33)) \
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
    counts = fixed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (fixed.join(F.broadcast(offsets), "_pid", "inner")
            .withColumn(rank_col, (F.col("_off") + F.col("_pos") + F.lit(1)).cast("bigint"))
            .withColumn(keep_range or "_pid", F.col("_pid"))
            .drop("_mid", "_pos", "_off", *(["_pid"] if keep_range != "_pid" else [])))


def tie_spans(df: DataFrame, value_col: str, key_cols: Sequence[str], rank: str, first: str, last: str,
              descending: bool = False) -> DataFrame:
    """Rank of every row by (value, key), and the first and last rank of the rows with its value.

    Equal values lie side by side, so inside a range a tie is a group of that range; only
    the first and last value of a range can reach into another one.  These are at most
    2 P values, whose ends over all ranges are broadcast.  No row is shuffled by its value
    alone, however many rows share it.
    """
    order = F.col(value_col).desc() if descending else F.col(value_col).asc()
    ranked = global_rank(df, [order, *key_cols], rank, keep_range="_range")
    ties = ranked.groupBy("_range", value_col).agg(F.min(rank).alias(first), F.max(rank).alias(last))
    ends = ranked.groupBy("_range").agg(F.min(rank).alias("_lo"), F.max(rank).alias("_hi"))
    edge = (ties.join(F.broadcast(ends), "_range").where((F.col(first) == F.col("_lo")) | (F.col(last) == F.col("_hi")))
            .groupBy(value_col).agg(F.min(first).alias("_from"), F.max(last).alias("_to")))
    ties = ties.join(F.broadcast(edge), value_col, "left").select(
        "_range", value_col, F.coalesce("_from", first).alias(first), F.coalesce("_to", last).alias(last))
    return ranked.join(ties, ["_range", value_col], "inner").drop("_range")


def average_rank(df: DataFrame, value_col: str, key_cols: Sequence[str], out_col: str,
                 descending: str | None = None) -> DataFrame:
    """Average (tie-aware) 1-based rank of ``value_col``, like ``scipy.stats.rankdata``.

    Descending, with the rank itself, if ``descending`` names a column for that rank.
    """
    rank = descending or f"_r_{out_col}"
    out = tie_spans(df, value_col, key_cols, rank, "_first", "_last", descending is not None)
    out = out.withColumn(out_col, (F.col("_first") + F.col("_last")) / F.lit(2.0)).drop("_first", "_last")
    return out if descending else out.drop(rank)


def decile_from_rank(rank: Column, n: Column, bins: int = 10) -> Column:
    """Equal-frequency bin (1 = lowest) of a 1-based rank among n rows.

    Integer form of ``qcut(rank, bins)``: greatest(1, ceil(bins*(r-1)/(n-1))),
    and 1 when n == 1.
    """
    num = F.lit(bins) * (rank - F.lit(1))
    den = n - F.lit(1)
    q = F.floor((num + den - F.lit(1)) / den).cast("int")
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), q))


def global_prefix_sum(df: DataFrame, order: Sequence[str | Column], weights: Sequence[str],
                      prefix: str = "cum_", partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``weights`` in the global ``order`` (ending in a unique key).

    Same range layout as ``global_rank``; running sums inside a range use a window
    partitioned by the range id (each range holds about n/P rows), and the P range
    totals give the offsets.
    """
    spark = df.sparkSession
    p = int(partitions or default_parallelism(spark))
    sort = [_as_sort(c) for c in order]
    ordered = (df.repartitionByRange(p, *sort).sortWithinPartitions(*sort)
               .withColumn("_mid", F.monotonically_increasing_id()))
    fixed = materialize(ordered, "prefix").withColumn("_pid", F.shiftright("_mid", 33))
    totals = fixed.groupBy("_pid").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0)).alias(f"_o_{w}")
                                      for w in weights])
    running = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    out = fixed.join(F.broadcast(offsets), "_pid", "inner")
    for w in weights:
        out = out.withColumn(f"{prefix}{w}", F.col(f"_o_{w}") + F.sum(w).over(running))
    return out.drop("_mid", "_pid", *[f"_o_{w}" for w in weights])
