"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source's documents are shuffled by a hash and queue up, and the queue repeats up to
REPEATS times. A copy's virtual finish time is the number of its source's words up to and
with it, divided by the source's target. All copies are range-sorted by that time and the
order is cut at the total budget: the mix takes the copies before the cut, and of the copy
that crosses it the words that are left.

Targets: sources share the budget by weight; a target stops at REPEATS times its source's
size, and what is over is shared again by weight until no target is above.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stage, table
from .order import placed

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, repeating; most copies of a document; name of the shuffle.
WEIGHTS, REPEATS, SEED = (1, 2, 3), 3, "mix"


def sized(docs: DataFrame, key: str, source: str, text: str, seed: str = SEED) -> DataFrame:
    """id, src, size, place, row. ``src`` sorts by code point with null last and is never null; ``place`` is the shuffle's order."""
    src = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    place = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "size")), 1, 16)
    return docs.select(F.col(key).alias("id"), src.alias("src"), words.alias("size")).withColumn("place", place).withColumn("row", F.monotonically_increasing_id())


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """src, source_size, longest, target of each source, from its src, source_size and longest.

    A round is one aggregate over the sources, of which the driver reads three numbers.
    """
    every = placed(sizes.withColumn("all", F.lit(0)), "all", ["src"], "sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int")).cast("long")
    every = stage(every.select("src", "source_size", "longest", weight.alias("weight")), "source-weights")
    budget, rest_weight = every.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, capped = budget, 0
    while True:
        full = F.expr(f"cast(source_size as decimal(20,0)) * {repeats * rest_weight}L <= cast(weight as decimal(20,0)) * {rest}L")
        taken, left, n = every.agg(F.coalesce(F.sum(F.when(full, repeats * F.col("source_size"))), F.lit(0)),
                                   F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.count_if(full)).first()
        if n == capped:
            break
        rest, rest_weight, capped = budget - taken, left, n
    share = (F.col("weight") * F.lit(rest)) / F.lit(max(rest_weight, 1))
    return every.select("src", "source_size", "longest", F.when(full, (repeats * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def _finish(start: Column) -> Column:
    return (start + F.col("size")) / F.col("target")


@dataclass
class Queue:
    """``rows``: id, src, size, before, source_size, target of every document; ``copies``: the queued copies by
    virtual finish time (finish, src, start, size, id, repeat), in ranges; ``cut``: finish, src and start of the copy
    that crosses the budget and its words within it (None: there are no words)."""

    rows: DataFrame
    copies: DataFrame
    cut: tuple | None
    repeats: int

    def _words(self, finish: Column, start: Column) -> Column:
        if self.cut is None:
            return F.lit(0).cast("long")
        here = F.struct(finish.alias("a"), F.col("src").alias("b"), start.alias("c"))
        at = F.struct(F.lit(self.cut[0]).alias("a"), F.lit(self.cut[1]).alias("b"), F.lit(self.cut[2]).cast("long").alias("c"))
        return F.when(here < at, F.col("size")).when(here == at, F.lit(self.cut[3])).otherwise(F.lit(0)).cast("long")

    def mix(self) -> DataFrame:
        """The mix itself, in its order within ranges: id, repeat (from 0), finish, words (all of the document's but in the last copy)."""
        return self.copies.select("id", "repeat", "finish", self._words(F.col("finish"), F.col("start")).alias("words")).where("words > 0")

    def taken(self) -> DataFrame:
        """id, size, source_size, target, taken of every document; ``taken`` adds up its copies in the mix."""
        total = F.lit(0).cast("long")
        for k in range(self.repeats):
            start = F.col("before") + k * F.col("source_size")
            total = total + F.when((F.col("size") > 0) & (F.col("target") > 0), self._words(_finish(start), start)).otherwise(F.lit(0))
        return self.rows.select("id", "size", "source_size", "target", total.alias("taken"))


def fair_queue(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS,
               repeats: int = REPEATS, seed: str = SEED) -> Queue:
    """The queue of all documents; the budget is the number of all words.

    A document's size is its number of words (null text: 0). A null source is a source, the
    last one. Rows that repeat one another are documents of their own; as they are alike
    in all that is returned, it doesn't matter which of them goes first. Documents without
    words are in ``rows`` and take nothing. An empty table gives an empty queue. Other
    columns are not read. Copies that finish long behind the budget are not queued: until
    time 1 + the largest (longest document / target) of the uncapped sources, every source
    has reached its target, so the cut lies before it.
    """
    rows = stage(sized(docs, key, source, text, seed), "mix-sizes")
    goals = stage(targets(rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.max("size").alias("longest")), weights, repeats), "mix-targets")
    rows = stage(placed(rows, "src", ["place", "id", "size", "row"], "mix-order", "size", goals).select(
        "id", "src", "size", "before", "source_size", "target"), "mix-rows")
    late = F.max(F.when(F.col("target") < repeats * F.col("source_size"), F.col("longest") / F.col("target")))
    budget, behind = goals.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(late, F.lit(0.0))).first()
    start = F.col("before") + F.col("repeat") * F.col("source_size")
    copies = (rows.where("size > 0 AND target > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
              .select(_finish(start).alias("finish"), "src", start.alias("start"), "size", "id", "repeat").where(F.col("finish") <= (1 + behind) * (1 + 1e-9)))
    order = ["finish", "src", "start"]
    laid = stage(copies.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "mix-copies")
    return Queue(rows, laid, _cut(laid, order, budget), repeats)


def _cut(laid: DataFrame, order: list[str], budget: int) -> tuple | None:
    """Where the running number of words reaches the budget: sums of the ranges first, then the rows of one range."""
    if not budget:
        return None
    sums = laid.groupBy("range").agg(F.sum("size").alias("words"))
    upto = sums.withColumn("upto", F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))
    hit = upto.where(F.col("upto") >= budget).orderBy("range").first()
    run = F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rest = F.lit(budget - (hit["upto"] - hit["words"])) - (F.col("run") - F.col("size"))
    inside = laid.where(F.col("range") == hit["range"]).withColumn("run", run).withColumn("rest", rest)
    return tuple(inside.where("rest > 0").orderBy(F.col("run").desc()).select(*order, "rest").first())


def op11_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: sources weigh 1, 2, 3, repeating, and share the number of all words."""
    queue = fair_queue(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return queue.taken().withColumnRenamed("id", "doc_id")


QUERIES = {"op11_fair_queue": op11_fair_queue}
SQL = {"op11_fair_queue": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY source),
c AS (
  SELECT *, sum(source_size) OVER () AS budget,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_cap,
    sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM s),
f AS (
  SELECT *, 3 * source_size::HUGEINT * rest_w <= w * (budget - before_cap) AS capped FROM c),
g AS (
  SELECT f.*, (budget - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0))::BIGINT AS rest, sum(w) FILTER (NOT capped) OVER () AS free_w FROM f),
t AS (
  SELECT source, source_size, budget, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (rest * w)::DOUBLE / free_w::DOUBLE END AS target FROM g),
q AS (
  SELECT row_number() OVER () AS rid, d.*, t.source_size, t.target, t.budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY substring(md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), size::VARCHAR)), 1, 16),
                    doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT q.*, (upto + r * source_size)::DOUBLE / target AS finish, upto + r * source_size AS place FROM q, range(0, 3) AS x(r) WHERE size > 0 AND target > 0),
m AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS earlier FROM k),
n AS (
  SELECT rid, sum(least(size, greatest(budget - earlier, 0)))::BIGINT AS taken FROM m GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN n USING (rid)
"""}
