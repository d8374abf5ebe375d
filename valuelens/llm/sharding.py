"""Sharding over fixed virtual slots.

Records hash into ``slots`` virtual slots for ever; a versioned map says which shard
holds each slot. Rebalancing aggregates bytes per slot, edits the newest map (moving as
few slots as needed) and stores the edit as the next version, so older versions still
say where a record was. The map has ``slots`` rows whatever the input's size: that
bounds what the driver holds and what is broadcast.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, stage_path, table, utf8

SLOTS = 4096
SHARDS = 16


def with_slots(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32, vslot of every row.

    The key alone decides the slot; a row without a key hashes its text, so that many
    such rows do not share one slot. size: UTF-8 bytes plus 1 (a null text: 1).
    """
    body = utf8(text)
    named = F.when(F.col(key).isNull(), F.xxhash64(F.lit("no key"), body)).otherwise(F.xxhash64(F.col(key)))
    return df.select(F.col(key), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
                     F.crc32(body).alias("text_crc32"), F.pmod(named, F.lit(slots)).cast("int").alias("vslot"))


def slot_totals(slotted: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot (``slots`` numbers each reach the driver)."""
    rows = slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    size, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in rows:
        size[r.vslot], count[r.vslot] = r.b, r.n
    return size, count


def first_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """The map before any size is known: slots dealt round robin."""
    return np.arange(slots, dtype=np.int64) % shards


def rebalance(size: np.ndarray, current: np.ndarray, shards: int, steps: int = 2000) -> np.ndarray:
    """Edit a slot map until shard sizes are near equal.

    Shards above the mean give up slots, smallest first, until they fit; these go to the
    emptiest shards, largest first. Then single moves and swaps between the fullest and
    the emptiest shard go on while they narrow the gap. Ties go to the lower number, so
    equal input gives equal maps. ``shards`` may exceed what the current map uses.
    """
    new = current.copy()
    load = np.bincount(new, size, shards).astype(np.int64)
    mean, pool = size.sum() / shards, []
    for shard in np.flatnonzero(load > mean):
        own = np.flatnonzero(new == shard)
        for s in own[np.argsort(size[own], kind="stable")]:
            if load[shard] <= mean:
                break
            if size[s]:
                load[shard] -= size[s]
                pool.append(int(s))
    heap = [(int(load[k]), k) for k in range(shards)]
    heapq.heapify(heap)
    for s in sorted(pool, key=lambda s: (-size[s], s)):
        at, shard = heapq.heappop(heap)
        new[s] = shard
        heapq.heappush(heap, (at + int(size[s]), shard))
    load = np.bincount(new, size, shards).astype(np.int64)
    for _ in range(steps):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        a, b = np.flatnonzero((new == hi) & (size > 0)), np.flatnonzero(new == lo)
        if gap <= 1 or not len(a):
            break
        b = np.concatenate([[-1], b])  # -1: a move without a return
        give = np.where(b >= 0, size[b], 0)
        b, give = b[order := np.argsort(give, kind="stable")], give[order]
        best = (gap, -1, -1)
        for s in a:
            k = int(np.searchsorted(give, size[s] - gap / 2))
            for j in (k - 1, k):
                if 0 <= j < len(b) and 0 < size[s] - give[j] < gap:
                    best = min(best, (abs(gap - 2 * (size[s] - give[j])), int(s), int(b[j])))
        if best[1] < 0:
            break
        _, s, t = best
        new[s] = lo
        if t >= 0:
            new[t] = hi
        load = np.bincount(new, size, shards).astype(np.int64)
    return new


def save_map(spark: SparkSession, path: str, version: int, shard_of: np.ndarray, count: np.ndarray | None = None) -> DataFrame:
    """Store one version of the map: slot, shard, and base, the rows of the shard in its lower slots."""
    count = np.zeros(len(shard_of), np.int64) if count is None else count
    base = np.zeros(len(shard_of), np.int64)
    for shard in np.unique(shard_of):
        own = np.flatnonzero(shard_of == shard)
        base[own] = np.cumsum(count[own]) - count[own]
    rows = pd.DataFrame({"vslot": np.arange(len(shard_of), dtype=np.int32), "shard": shard_of.astype(np.int32), "base": base})
    spark.createDataFrame(rows).write.parquet(f"{path}/version={version}")
    return load_map(spark, path, version)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, or the newest."""
    if version is not None:
        return spark.read.parquet(f"{path}/version={version}")
    every = spark.read.parquet(path)
    newest = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == newest).drop("version")


def shard(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", slots: int = SLOTS,
          map_path: str | None = None) -> DataFrame:
    """Shard every row: key, size, text_crc32, vslot, shard, slot, map_version.

    Version 0 of the map deals slots round robin; version 1 is its edit by the bytes
    that this table has in each slot, and places the rows. slot numbers a shard's rows
    from 0 without gaps, by virtual slot and then key. Null and empty texts have size 1.
    Repeated rows with one key share a slot and stay separate rows; an empty table gives
    an empty result; other columns of the input are not read.
    """
    spark = df.sparkSession
    path = map_path or stage_path(spark, "slot-map")
    slotted = stage(with_slots(df, key, text, slots), "slots")
    size, count = slot_totals(slotted, slots)
    start = first_map(shards, slots)
    save_map(spark, path, 0, start)
    newest = save_map(spark, path, 1, rebalance(size, start, shards), count)
    order = Window.partitionBy("vslot").orderBy(key, "text_crc32", "size")
    return (slotted.withColumn("_n", F.row_number().over(order)).join(F.broadcast(newest), "vslot")
            .select(key, "size", "text_crc32", "vslot", "shard", (F.col("base") + F.col("_n") - 1).cast("long").alias("slot"),
                    F.lit(1).alias("map_version")))


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


QUERIES = {"op1_virtual_slots": op1_virtual_slots}
