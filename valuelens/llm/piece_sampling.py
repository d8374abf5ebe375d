"""Sampled SentencePiece segmentations and lossless decoding.

A text is segmented by forward filtering and backward sampling over the lattice of all
pieces that spell it: the forward pass sums the weights of all ways to reach a byte, the
backward pass draws one piece after the other from the end, each with its share of that
sum. Draws are hashes of the row's key and the byte's place, so a segmentation does not
depend on partitions, batches or retries.

The vocabulary file ranks its pieces without probabilities; a piece of rank r weighs
1 / (r + 1) ** alpha, normalised (Zipf's law). Bytes that no piece spells take byte pieces.
No piece holds a space behind its first character, so each space starts a lattice of its
own; equal ones share a forward pass.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, table
from .textnum import Chunk, chunks, mix, ragged, uniform

MODEL = "piece_bpe_32k.model"
#: Log weight of a byte piece, far below any spelled piece.
BYTE_WEIGHT = -40.0
_SLOTS = 1 << 19
#: Bytes of text that share lattices, and ids that are decoded together.
CHUNK, RUN = 1 << 19, 500_000
_loaded: dict = {}


class Pieces:
    """The vocabulary as byte strings: surfaces for decoding, and a hash table of all their beginnings."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.surface = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        score = {}
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.surface[i] = bytes([int(piece[1:-1], 16)])
                self.byte_id[self.surface[i][0]] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.surface[i] = piece.replace("▁", " ").encode()
                # runs of spaces have no rank; a lone space ranks last
                if (m.get_score(i) > -1e8 or len(piece) == 1) and " " not in self.surface[i].decode()[1:]:
                    score[self.surface[i]] = (m.get_score(i), i)
        rank = {s: k for k, (s, _) in enumerate(sorted(score.items(), key=lambda kv: (-kv[1][0], kv[1][1])))}
        weight = {s: -alpha * np.log(r + 1.0) for s, r in rank.items()}
        norm = np.log(sum(np.exp(w) for w in weight.values()))
        begins = sorted({s[:k] for s in score for k in range(1, len(s) + 1)})
        self.longest = max(map(len, score))
        lens = np.array([len(b) for b in begins])
        c = Chunk(np.frombuffer(b"".join(begins), np.uint8), np.concatenate([[0], np.cumsum(lens)]))
        h = c.hashes(c.off[:-1], c.off[1:])
        self.key, self.id, self.weight = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32), np.zeros(_SLOTS)
        self.single = np.zeros(_SLOTS, bool)  # pieces of one character
        self.used = np.zeros(_SLOTS, bool)
        self.probes = 1
        for b, x in zip(begins, h.tolist(), strict=True):
            at, tries = x >> 45, 1
            while self.used[at]:
                at, tries = (at + 1) % _SLOTS, tries + 1
            self.probes = max(self.probes, tries)
            self.used[at], self.key[at] = True, x
            if b in score:
                self.id[at], self.weight[at] = score[b][1], weight[b] - norm
                self.single[at] = len(b.decode()) == 1
        lens = np.array([len(s) for s in self.surface])
        self.flat, self.first, self.length = np.frombuffer(b"".join(self.surface), np.uint8), np.concatenate([[0], np.cumsum(lens)])[:-1], lens

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is no beginning of a piece."""
        at = (h >> np.uint64(45)).astype(np.int64)
        out = np.where(self.used[at] & (self.key[at] == h), at, -1)
        left = np.flatnonzero((out < 0) & self.used[at])
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) % _SLOTS
            here = at[left]
            hit = self.used[here] & (self.key[here] == h[left])
            out[left[hit]] = here[hit]
            left = left[~hit & self.used[here]]
        return out


def vocabulary(path: str | None, alpha: float) -> Pieces:
    """Loaded once in each Python process."""
    path = path or public_tokenizers.path(MODEL)
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Pieces(path, alpha)
    return _loaded[path, alpha]


class Lattice:
    """Arcs and forward sums of many short byte strings, side by side.

    String i has nodes base[i] .. base[i] + length. Arcs are sorted by the depth of the
    node they end in, then by that node and by length, whatever the strings beside them.
    """

    def __init__(self, c: Chunk, v: Pieces):
        n = np.diff(c.off)
        self.base = c.off[:-1] + np.arange(c.n)
        owner = np.repeat(np.arange(c.n, dtype=np.int32), n)
        place = (np.arange(len(c.data)) - c.off[:-1][owner]).astype(np.int32)
        at, limit = np.arange(len(c.data)), c.off[1:][owner]
        starts, lengths, ids, weights = [], [], [], []
        bare = np.ones(len(c.data), bool)  # bytes of characters that have no piece of their own
        for length in range(1, v.longest + 1):
            at = at[at + length <= limit[at]]
            if not len(at):
                break
            slot = v.find(c.hashes(at, at + length))
            at, slot = at[slot >= 0], slot[slot >= 0]
            piece = np.flatnonzero(v.id[slot] >= 0)
            begin, slots = at[piece], slot[piece]
            starts.append(begin)
            lengths.append(np.full(len(begin), length, np.int32))
            ids.append(v.id[slots])
            weights.append(v.weight[slots])
            if length <= 4:
                single = begin[v.single[slots]]
                for j in range(length):
                    bare[single + j] = False
        bare = np.flatnonzero(bare)
        start = np.concatenate([*starts, bare])
        length = np.concatenate([*lengths, np.ones(len(bare), np.int32)])
        total = len(c.data) + c.n
        depth, node = place[start] + length, start + owner[start] + length
        order = np.argsort((depth.astype(np.int64) * total + node) * 64 + length)
        depth, node = depth[order], node[order]
        self.start = node - length[order]
        self.id = np.concatenate([*ids, v.byte_id[c.data[bare]]])[order]
        weight = np.concatenate([*weights, np.full(len(bare), BYTE_WEIGHT)])[order]
        self.depth = np.zeros(total, np.int32)
        self.depth[np.arange(len(c.data)) + owner + 1] = place + 1
        seg = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        behind = np.append(seg[1:], len(node))[:len(seg)]
        self.first, self.last = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.first[node[seg]], self.last[node[seg]] = seg, behind - 1
        alpha, p = np.zeros(total), np.empty(len(node))
        cut = np.searchsorted(depth[seg], np.arange(1, int(n.max(initial=0)) + 2))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            lo, hi = seg[a], behind[b - 1]
            x = alpha[self.start[lo:hi]] + weight[lo:hi]
            each, size = seg[a:b] - lo, behind[a:b] - seg[a:b]
            top = np.maximum.reduceat(x, each)
            x = np.exp(x - np.repeat(top, size))
            total_x = np.add.reduceat(x, each)
            alpha[node[seg[a:b]]] = np.log(total_x) + top
            p[lo:hi] = x / np.repeat(total_x, size)
        self.share = p  # of a node's sum, by arc

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An arc into each node, by a uniform number each; only the node's own shares are read, so its neighbours don't matter."""
        arc, last = self.first[node], self.last[node]
        left = np.flatnonzero((self.share[arc] <= u) & (arc < last))
        rest = u[left]
        while len(left):
            rest = rest - self.share[arc[left]]
            arc[left] += 1
            here = arc[left]
            more = (self.share[here] <= rest) & (here < last[left])
            left, rest = left[more], rest[more]
        return arc


def sample_ids(c: Chunk, seed: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all texts in a row, and each text's first index. ``seed``: a uint64 per text."""
    full = np.diff(c.off) > 0
    lead = np.cumsum(full)  # a leading space for each text that is not empty, as the vocabulary expects
    data = np.insert(c.data, c.off[:-1][full], 0x20)
    off = c.off + np.concatenate([[0], lead])
    start = np.flatnonzero(data == 0x20)
    end = np.append(start[1:], len(data))[:len(start)]  # every text starts with a space, so no unit crosses texts
    text = np.searchsorted(off, start, "right") - 1
    spaced = Chunk(data, off)
    _, sample, which = np.unique(spaced.hashes(start, end), return_index=True, return_inverse=True)
    which = which.ravel()
    length = (end - start)[sample]
    lattice = Lattice(Chunk(data[ragged(start[sample], length)], np.concatenate([[0], np.cumsum(length)])), v)
    node = lattice.base[which] + (end - start)
    place = start - off[text]  # in its text, so that a draw follows the key and the byte alone
    key = mix(seed[text])
    live, drawn = np.arange(len(start)), []
    while len(live):
        here = node[live]
        u = uniform(key[live] + (place[live] + lattice.depth[here]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        arc = lattice.draw(here, u)
        drawn.append((live, lattice.id[arc]))
        node[live] = lattice.start[arc]
        live = live[lattice.depth[node[live]] > 0]
    count = np.zeros(len(start), np.int64)
    for units, _ in drawn:
        count[units] += 1
    behind = np.cumsum(count)
    out = np.empty(int(behind[-1]) if len(behind) else 0, np.int32)
    for k, (units, ids) in enumerate(drawn):
        out[behind[units] - 1 - k] = ids
    first = np.concatenate([[0], behind])[np.searchsorted(start, off)]
    return out, first


def spelled(ids: np.ndarray, first: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that rows of ids spell (row i: ids first[i]..first[i + 1])."""
    size = v.length[ids]
    data = v.flat[ragged(v.first[ids], size)]
    off = np.concatenate([[0], np.cumsum(size)])[first]
    lead = np.diff(off) > 0  # the leading space goes
    data = np.delete(data, off[:-1][lead])
    return data, (off - np.concatenate([[0], np.cumsum(lead)])).astype(np.int64)


def _crcs(ids: np.ndarray, first: np.ndarray) -> list[int]:
    raw = ids.astype("<u4").tobytes()
    return [zlib.crc32(raw[a:b]) for a, b in zip((first[:-1] * 4).tolist(), (first[1:] * 4).tolist(), strict=True)]


def _segmented(df: DataFrame, keep: list[str], key: str, text: str, path: str | None, alpha: float, seed: int, new: str, columns) -> DataFrame:
    """``keep`` and the ``new`` columns, the arrays that ``columns(chunk, ids, first, nulls, v)`` gives; a new name that ``keep`` has gets an underscore in front."""
    mark, null = free_name(df, "_seed"), free_name(df, "_null")
    marked = df.withColumns({mark: F.xxhash64(F.col(key), F.lit(seed)), null: F.col(text).isNull()})
    kept = df.select(*keep)
    added = T.StructType([T.StructField(free_name(kept, f.name), f.dataType) for f in T.StructType.fromDDL(new)])
    schema = T.StructType([df.schema[c] for c in keep] + list(added))
    width = len(keep)

    def run(batches):
        v = vocabulary(path, alpha)
        for batch in batches:
            seeds, nulls = (batch.column(width + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for c in chunks(batch.column(width + 2), CHUNK):
                rows = slice(c.first, c.first + c.n)
                ids, first = sample_ids(c, seeds[rows].astype(np.int64).view(np.uint64), v)
                old = [batch.column(i).slice(c.first, c.n) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*old, *columns(c, ids, first, nulls[rows], v)], names=schema.names)

    return marked.select(*keep, mark, null, text).mapInArrow(run, schema)


def encode(df: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", path: str | None = None, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """``keep`` columns, ids array<int> and ids_crc32 (of little-endian 32-bit ids) of every row.

    A null text has null ids and crc, an empty one no ids. Rows with one key and one text
    (a null key is a key too) have one segmentation; an empty table gives an empty result.
    A new name that ``keep`` has already gets an underscore in front; other columns are not read.
    """
    def columns(c, ids, first, null, v):
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=pa.array(null) if null.any() else None)
        return lists, pa.array(_crcs(ids, first), pa.int64(), mask=null)

    return _segmented(df, keep, key, text, path, alpha, seed, "ids array<int>, ids_crc32 long", columns)


def round_trip(df: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", path: str | None = None, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """``keep`` columns, n_pieces, ids_crc32 and lossless: every text is encoded, decoded again and compared byte by byte in one pass.

    A null text has null n_pieces and crc and is lossless, as it has null ids, which spell null. Otherwise as ``encode``.
    """
    def columns(c, ids, first, null, v):
        data, off = spelled(ids, first, v)
        same = np.diff(off) == np.diff(c.off)
        if len(data) != len(c.data) or not (off == c.off).all() or not (data == c.data).all():
            same &= np.array([data[a:b].tobytes() == c.text(i) for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))], bool)
        return pa.array(np.diff(first), pa.int64(), mask=null), pa.array(_crcs(ids, first), pa.int64(), mask=null), pa.array(same | null)

    return _segmented(df, keep, key, text, path, alpha, seed, "n_pieces long, ids_crc32 long, lossless boolean", columns)


def decode(df: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """``keep`` columns and the text that the ids spell (null for null)."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("text", T.StringType())])
    width = len(keep)

    def run(batches):
        v = vocabulary(path, 1.0)
        for batch in batches:
            count = batch.column(width).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            behind = np.concatenate([[0], np.cumsum(count)])
            row = 0
            while row < batch.num_rows:  # runs of whole rows with about RUN ids, so memory doesn't follow the batch
                end = max(row + 1, int(np.searchsorted(behind, behind[row] + RUN, "right")) - 1)
                part = batch.slice(row, end - row)
                lists = part.column(width)
                data, off = spelled(lists.flatten().to_numpy(zero_copy_only=False), behind[row:end + 1] - behind[row], v)
                row = end
                text = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(off), pa.py_buffer(data)])
                if lists.null_count:
                    text = pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.large_string()), text)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(width)], text.cast(pa.string())], names=schema.names)

    return df.select(*keep, ids).mapInArrow(run, schema)


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, decoded again and compared with the text."""
    body = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(body).alias("text_crc32"), F.octet_length(body).cast("long").alias("n_bytes"))
    return round_trip(docs, ["doc_id", "n_bytes", "text_crc32"]).select("doc_id", "n_bytes", "n_pieces", "ids_crc32", "text_crc32", "lossless")


QUERIES = {"op5_sampled_pieces": op5_sampled_pieces}
