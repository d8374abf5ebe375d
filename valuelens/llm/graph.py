"""Links between rows: connected components, and all pairs of a group in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links a-b.

    Alternating large-star and small-star rounds: each node's larger neighbours, then its
    smaller ones, are linked to the least node it knows, until the links stay the same.
    Rounds are stored, so lineage stays short; the driver reads a count and a checksum.
    """
    links = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "links")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        small = stage(small, "links")
        drop_stage(large)
        drop_stage(links)
        links = small
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    stars = links.groupBy("u").agg(F.min("v").alias("component"))
    heads = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(heads)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index that each of 0..n-1 reaches over the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # roots hook to lower roots
        while (label[label] != label).any():
            label = label[label]
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]
    return label


def into_blocks(df: DataFrame, group: str, key: str, blocks: Column) -> DataFrame:
    """Rows dealt so that every pair of a group meets: adds _block, _lo, _hi.

    A group is cut by a hash of ``key`` into as many blocks as ``blocks`` says (a column,
    the same for all rows of a group); each pair of blocks, and each block with itself,
    is one unit (group, _lo, _hi). Group size bounds neither a unit nor a task.
    """
    own = F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")
    return (df.withColumn("_blocks", blocks.cast("int")).withColumn("_block", own)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .withColumns({"_lo": F.least("_block", "_other"), "_hi": F.greatest("_block", "_other")}).drop("_other", "_blocks"))


def in_units(df: DataFrame, unit: list[str], order: list[str]) -> DataFrame:
    """Rows of a unit side by side in one partition, for ``whole_units``; ``unit`` columns come first."""
    rest = [c for c in df.columns if c not in unit]
    return df.select(*unit, *rest).repartition(*unit).sortWithinPartitions(*unit, *order)


def whole_units(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units (equal first ``width`` columns, sorted) and the units' first rows, ends included."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        edges = _edges(held, width)
        if len(edges):
            last = int(edges[-1])
            yield held.slice(0, last).combine_chunks(), np.concatenate([[0], edges])
            held = held.slice(last)
    if held is not None:
        yield held.combine_chunks(), np.concatenate([[0], _edges(held, width), [held.num_rows]])


def _edges(t: pa.Table, width: int) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    for k in range(width):
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def pairs(first: np.ndarray, block: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of all units in runs of about ``most``: within a block, or across the two blocks of a unit."""
    wait_i, wait_j, n = [], [], 0
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        for x in range(a, b - 1):
            j = np.arange(x + 1, b)
            if lo[a] != hi[a]:
                j = j[block[j] != block[x]]
            wait_i.append(np.full(len(j), x))
            wait_j.append(j)
            n += len(j)
            if n >= most:
                yield np.concatenate(wait_i), np.concatenate(wait_j)
                wait_i, wait_j, n = [], [], 0
    if n:
        yield np.concatenate(wait_i), np.concatenate(wait_j)
