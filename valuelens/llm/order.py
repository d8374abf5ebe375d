"""Places and running sums inside groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage


def placed(df: DataFrame, group: str, order: list[str], label: str, value: str | None = None, facts: DataFrame | None = None) -> DataFrame:
    """``df`` with ``before``, the sum of ``value`` over the earlier rows of the group, and ``total``, that over all of them.

    ``value`` is a long column (None: every row counts 1), ``group`` a column without
    nulls. ``order`` ends in a column that tells all rows apart, so that rows which are
    equal otherwise are split too. ``facts`` has more columns for each group. Rows are
    range-partitioned by group and order and stored; each range and group has one row of
    sums, and a window over these (a group has at most one for each range) gives what
    lies before. The rows meet their sums by range and group: no key has more rows than
    a range. Uses the names _mid, _pid, _first and _base.
    """
    by = [group, *order]
    laid = stage(df.repartitionByRange(partitions(df.sparkSession), *by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id()), label)
    laid = laid.withColumn("_pid", F.shiftright("_mid", 33))
    sums = laid.groupBy("_pid", group).agg(F.sum(F.lit(1) if value is None else F.col(value)).cast("long").alias("_sum"), F.min("_mid").alias("_first"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_pid", group, "_first", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.sum("_sum").over(whole).alias("total"))
    rows = laid.join(stage(sums if facts is None else sums.join(facts, group), f"{label}-sums"), ["_pid", group])
    if value is None:
        inside = F.col("_mid") - F.col("_first")
    else:
        inside = F.coalesce(F.sum(value).over(Window.partitionBy("_pid", group).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", (F.col("_base") + inside).cast("long")).drop("_mid", "_pid", "_first", "_base")
