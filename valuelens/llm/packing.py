"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut at multiples of the sequence length; whole pieces fill a
sequence each. The rest pieces are dealt into groups of bounded size by a hash. In a
group every piece starts as a partial partition of all windows; the two partial
partitions that are least balanced merge, largest load against smallest, until one
partition is left, with windows of near-equal load. Where a window exceeds the
sequence length, the window count rises and the group is partitioned again.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import os
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import stage, table
from .textnum import Chunk, chunks, ragged

SEQUENCE, END = 2048, 1
#: Rest pieces in a group, about; words whose ids a process remembers, and places for them.
GROUP, REMEMBERED, SLOTS = 512, 1_200_000, 1 << 21
#: Ids of sequences: group * SPAN + number in the group.
SPAN = 1 << 32
#: Bytes of text whose words are looked up together.
CHUNK = 2 << 20


def differencing(size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item and load of each of k windows, by largest differencing.

    The k largest items, the next k and so on start as one partial partition each: items
    of one such row never share a window, which is what merging them singly would do.
    """
    n = len(size)
    order = np.argsort(-size, kind="stable")
    rows = -(-n // k)
    padded = np.zeros(rows * k, np.int64)
    padded[:n] = size[order]
    node = np.full(rows * k, -1, np.int64)
    node[:n] = np.arange(n)
    parts = [(padded[i * k:(i + 1) * k], node[i * k:(i + 1) * k]) for i in range(rows)]
    heap = [(-int(p[0].max() - p[0].min()), i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    left, right = [], []
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        (a, na), (b, nb) = parts[i], parts[j]
        b, nb = b[::-1], nb[::-1]  # loads descend, so the largest meets the smallest
        load, both = a + b, (na >= 0) & (nb >= 0)
        joined = np.where(na >= 0, na, nb)
        joined[both] = n + len(left) + np.arange(int(both.sum()))
        left += na[both].tolist()
        right += nb[both].tolist()
        o = np.argsort(-load, kind="stable")
        parts.append((load[o], joined[o]))
        parts[i] = parts[j] = None
        heapq.heappush(heap, (-int(load[o[0]] - load[o[-1]]), len(parts) - 1))
    load, top = parts[heap[0][1]]
    window = np.full(n + len(left), -1, np.int64)
    window[top[top >= 0]] = np.flatnonzero(top >= 0)
    for x in range(len(left) - 1, -1, -1):  # from the last merge back to the items
        window[left[x]] = window[right[x]] = window[n + x]
    out = np.empty(n, np.int64)
    out[order] = window[:n]
    return out, load


def pack(size: np.ndarray, capacity: int = SEQUENCE) -> np.ndarray:
    """Window of each item, none over capacity; items are at most that long."""
    if not len(size):
        return np.zeros(0, np.int64)
    k = max(1, math.ceil(int(size.sum()) / capacity))
    while True:
        window, load = differencing(size, k)
        if load.max() <= capacity:
            return window
        k += max(1, k // 64)


_LETTER, _POINT = (np.isin(np.arange(256), list(s)) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b".,;:!?*$%&#"))


class WordIds:
    """Ids of whole texts from the ids of their words.

    This tokenizer drops white space and never joins symbols across it, nor a letter and
    a following ``_POINT`` mark, so a text's ids are those of its parts in order. Ids of up
    to REMEMBERED parts are kept between texts, in an open hash table of SLOTS places.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = re.compile("[A-Za-z]+").fullmatch
        self.forget()

    def forget(self) -> None:
        self.key, self.place = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.pool, self.first, self.count = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, h: np.ndarray, new: np.ndarray | None = None) -> np.ndarray:
        """Place of each distinct hash, -1 where it is unknown; with ``new``, store these places."""
        at, out, left = (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64), np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(left):
            here = at[left]
            if new is not None:  # of those that meet at a free slot, one gets it
                free = self.place[here] < 0
                self.place[here[free]] = new[left[free]]
                self.key[here] = np.where(self.place[here] == new[left], h[left], self.key[here])
            taken = self.place[here] >= 0
            hit = taken & (self.key[here] == h[left])
            out[left[hit]] = self.place[here[hit]]
            left = left[taken & ~hit]
            at[left] = (at[left] + 1) % SLOTS
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. One of ASCII letters only goes to the merges directly: lower case is all that precedes them."""
        out = [[t.id for t in self.tokenizer.model.tokenize(w.lower())] if self.plain(w) else None for w in words]
        other = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(other, self.tokenizer.encode_batch([words[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def parts(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end, _ = c.words()
        cut = np.flatnonzero(_LETTER[c.data[:-1]] & _POINT[c.data[1:]]) + 1
        cut = np.setdiff1d(cut, c.off, assume_unique=False)
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        return start, end, np.searchsorted(start, c.off)

    def __call__(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's END id included, and each text's first index."""
        start, end, first = self.parts(c)
        distinct, sample, which = np.unique(c.hashes(start, end), return_index=True, return_inverse=True)
        if len(self.first) + len(distinct) > REMEMBERED:
            self.forget()
        at = self.find(distinct)
        new = np.flatnonzero(at < 0)
        kept = new[:max(0, REMEMBERED - len(self.first))]  # one text may hold more words than are remembered
        if len(new):
            data = c.data.tobytes()
            ids = self.encode([data[start[i]:end[i]].decode("utf-8", "replace") for i in sample[new].tolist()])
            count = np.fromiter(map(len, ids), np.int32, len(ids))
            pool = np.fromiter(itertools.chain.from_iterable(ids), np.uint16, int(count.sum()))
            at[new] = len(self.first) + np.arange(len(new))
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(count, dtype=np.int64) - count])
            self.count, self.pool = np.concatenate([self.count, count]), np.concatenate([self.pool, pool])
            self.find(distinct[kept], at[kept])
        word = at[which.ravel()]
        count = self.count[word].astype(np.int64)
        flat = self.pool[ragged(self.first[word], count)]
        ends = np.concatenate([[0], np.cumsum(count)])[first[1:]]
        out = np.full(len(flat) + c.n, END, np.uint32)
        keep = np.ones(len(out), bool)
        keep[ends + np.arange(c.n)] = False
        out[keep] = flat
        return out, np.concatenate([[0], ends + np.arange(1, c.n + 1)])


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each Python process, which serves many tasks."""
    return WordIds(path)


def cut_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, sequence: int = SEQUENCE,
               rest: int = SEQUENCE // 4, with_ids: bool = False) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens (and ids) of every piece of every row.

    Pieces are ``sequence`` ids long; what remains of a document is cut at multiples of
    ``rest``, for items that a partition can balance. A null text has its END id only.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    new = "start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL(new)])
    kinds = [to_arrow_type(f.dataType) for f in schema][1:]

    def run(batches):
        encode = word_ids(path)
        for batch in batches:
            for c in chunks(batch.column(1), CHUNK):
                ids, first = encode(c)
                n = np.diff(first)
                tail = n - n % sequence
                whole, parts = tail // sequence, -(-(n % sequence) // rest)
                owner = np.repeat(np.arange(c.n), whole + parts)
                nth = ragged(np.zeros(c.n, np.int64), whole + parts)
                start = np.where(nth < whole[owner], nth * sequence, tail[owner] + (nth - whole[owner]) * rest)
                length = np.minimum(np.where(nth < whole[owner], sequence, rest), n[owner] - start)
                raw, a = ids.astype("<u4").tobytes(), (first[owner] + start) * 4
                crc = np.fromiter((zlib.crc32(raw[i:j]) for i, j in zip(a.tolist(), (a + length * 4).tolist(), strict=True)), np.int64, len(a))
                out = [start, length, crc, n[owner]]
                columns = [pa.array(x, t) for x, t in zip(out, kinds, strict=False)]
                if with_ids:
                    # pieces follow each other without a gap
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first[owner] + start, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n).take(pa.array(owner))] + columns, names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, sequence: int = SEQUENCE,
                   group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """The pieces of ``cut_pieces`` with sequence_id and offset.

    Rest pieces are dealt into groups of about ``group`` by a hash of their place in the
    stored table of pieces, so copies and repeated rows spread like any others; each
    group is packed on its own. Sequence ids are unique, not gapless. An empty table
    gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    pieces = stage(cut_pieces(df, key, text, path, sequence, with_ids=with_ids).withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(pieces.where(F.col("length") < sequence).count() / group))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_uid"), F.lit(groups)))
    full = dealt.where(F.col("length") == sequence).select("_uid", (F.lit(groups * SPAN) + F.col("_uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_uid", ignore_index=True)
        window = pack(rows["length"].to_numpy(), sequence)
        order = np.argsort(window, kind="stable")
        size = rows["length"].to_numpy()[order]
        run = np.cumsum(size) - size
        new = np.concatenate([[True], window[order][1:] != window[order][:-1]])
        offset = np.empty(len(rows), np.int64)
        offset[order] = run - np.maximum.accumulate(np.where(new, run, 0))
        return pd.DataFrame({"_uid": rows["_uid"], "sequence_id": rows["_group"] * SPAN + window, "offset": offset})

    rest = (dealt.where(F.col("length") < sequence).select("_uid", "_group", "length")
            .groupBy("_group").applyInPandas(one, "_uid long, sequence_id long, offset long"))
    placed = full.unionByName(rest)
    return pieces.join(placed, "_uid").drop("_uid")


def op9_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_karmarkar_karp": op9_karmarkar_karp}
