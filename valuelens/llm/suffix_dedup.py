"""Removal of long byte strings that occur twice, by column-wise suffix sorting.

Every window of ``span`` bytes has an anchor, its ``gram``-byte string of least hash
(leftmost on ties), and neighbouring windows with one anchor make a segment. Equal
windows have equal anchors at equal places, so only segments with one anchor value have
to meet, and those whose anchor occurs once are done with. Equal segments repeat whole.

Where segments with one anchor differ, a collection of them is sorted column by column,
from the right: each round puts one symbol in front of every segment's suffix, reads
that symbol from the collection's Burrows-Wheeler transform, re-sorts stably by it, and
updates the common prefix with the suffix before. Columns line up at the anchor, so
suffixes that share ``span`` bytes are in one round, and a round keeps one suffix per
segment. The columns of a collection are stored one after the other and read in that
order; a collection is bounded, so its columns are held in memory instead of in files.
An anchor value with more than ``HOT`` different segments has its windows compared by
hash through a shuffle, so that no task holds them all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stage, stage, table, utf8
from .graph import in_units, whole_units
from .textnum import U64, Chunk, chunks, column_bytes, mix, ragged, sums

SPAN, GRAM = 200, 32
#: Different segments of one anchor value in one collection.
HOT = 50_000
#: Windows looked at together; the lower bits of a key hold a place among them.
SLICE, PLACE_BITS = 1 << 19, 24


def _anchors(c: Chunk, span: int, gram: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor place of each window starting at begin..end-1, and the hash of each gram from ``begin`` on."""
    width = span - gram + 1
    last = min(end + width - 1, len(c.data) - gram + 1)
    at = np.arange(begin, last)
    h = c.hashes(at, at + gram)
    key = ((mix(h ^ U64(0xC2B2AE3D27D4EB4F)) >> U64(PLACE_BITS)) << U64(PLACE_BITS)) | np.arange(len(h), dtype=U64)
    full = np.full(-(-(len(key) + width) // width) * width, ~U64(0), U64)
    full[:len(key)] = key
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = end - begin
    least = np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
    return begin + (least & U64((1 << PLACE_BITS) - 1)).astype(np.int64), h


def segments(c: Chunk, span: int = SPAN, gram: int = GRAM) -> list[np.ndarray]:
    """text, start (in the text), windows, anchor (after the start), anchor value and hash of every segment."""
    out = []
    length = np.diff(c.off)
    valid_end = c.off[:-1] + np.maximum(length - span + 1, 0)  # past the last window of each text
    for begin in range(0, max(len(c.data) - span + 1, 0), SLICE):
        end = min(begin + SLICE, len(c.data) - span + 1)
        anchor, h = _anchors(c, span, gram, begin, end)
        at = np.arange(begin, end)
        text = np.searchsorted(c.off, at, "right") - 1
        at, text, anchor = (x[ok] for ok in [at < valid_end[text]] for x in (at, text, anchor))
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
        windows = np.diff(np.append(new, len(at)))
        s, a = at[new], anchor[new]
        out.append((text[new], s - c.off[text[new]], windows, a - s, h[a - begin], c.hashes(s, s + windows + span - 1)))
    if not out:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U64)] * 2
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _place(start: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (start << 20) | (windows << 10) | anchor


def segment_rows(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """value, seg, tkey, place, c: every segment of ``texts`` (tkey, text); texts equal in one chunk are read once, c times."""
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for c in chunks(batch.column(1)):
                _, first, count = np.unique(keys[c.first:c.first + c.n], return_index=True, return_counts=True)
                times = np.zeros(c.n, np.int64)
                times[first] = count
                text, start, windows, anchor, value, seg = segments(c, span, gram)
                ok = times[text] > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[ok]) for x in (value.view(np.int64), seg.view(np.int64), keys[c.first + text], _place(start, windows, anchor), times[text])],
                    names=["value", "seg", "tkey", "place", "c"])

    return texts.mapInArrow(run, "value long, seg long, tkey long, place long, c long")


def column_sort(bucket: np.ndarray, anchor: np.ndarray, windows: np.ndarray, data: np.ndarray, first: np.ndarray, span: int, gram: int) -> np.ndarray:
    """width x n matrix: does the window whose anchor lies that far behind its start share its bytes with another segment's.

    Segment i of ``bucket`` (sorted) is data[first[i]:first[i + 1]]. ``lcp[k]`` is the
    common prefix of the k-th suffix with the one before it in its bucket.
    """
    n, width = len(bucket), span - gram + 1
    left, size = width - 1, np.diff(first)
    columns = np.zeros((width - 1 + span + 1, n), np.uint16)  # 0: no symbol here
    columns[ragged(left - anchor, size), np.repeat(np.arange(n), size)] = data.astype(np.uint16) + 1
    hit = np.zeros((width, n), bool)
    order, lcp = np.arange(n), np.zeros(n + 1, np.int64)
    for col in range(width - 1 + span - 1, -1, -1):
        bwt = columns[col][order]  # what stands before each sorted suffix
        key = bucket[order] * 512 + bwt
        come = np.argsort(key, kind="stable")
        key, order = key[come], order[come]
        same = np.flatnonzero((key[1:] == key[:-1]) & (bwt[come][1:] > 0)) + 1
        new = np.zeros(n + 1, np.int64)
        a, b = come[same - 1] + 1, come[same]
        new[same] = lcp[b]
        far = np.flatnonzero(a < b)
        if len(far):  # other symbols stood between the two
            cut = np.column_stack([a[far], b[far] + 1]).ravel()
            new[same[far]] = np.minimum.reduceat(lcp, cut)[::2]
        new[same] = np.minimum(new[same] + 1, span)
        lcp = new
        if col <= left:
            long = lcp >= span
            hit[left - col, order[long[:-1] | long[1:]]] = True
    return hit


def _lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def repeated_windows(bodies: DataFrame, span: int, gram: int) -> DataFrame:
    """value, seg, wins: windows of each segment that another segment of its anchor value has too, by ``column_sort``."""
    def run(batches):
        for t, _ in whole_units(batches, 1):
            value, seg, place = (t.column(k).to_numpy() for k in (0, 1, 2))
            once = np.ones(len(value), bool)
            once[1:] = (value[1:] != value[:-1]) | (seg[1:] != seg[:-1])
            rows = pa.array(np.flatnonzero(once))
            value, seg, place = value[once], seg[once], place[once]
            anchor, windows = place & 1023, (place >> 10) & 1023
            data, first = column_bytes(t.column(3).take(rows))
            data, first = data[first[0]:first[-1]], first - first[0]
            bucket = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]]))
            hit = column_sort(bucket, anchor, windows, data, first, span, gram)
            far, i = np.nonzero(hit)
            win = anchor[i] - far
            order = np.lexsort((win, i))
            count = np.bincount(i, minlength=len(value))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(value[some]), pa.array(seg[some]), _lists(win[order], count[some])], names=["value", "seg", "wins"])

    return in_units(bodies.select("value", "seg", "place", "body"), ["value"], ["seg"]).mapInArrow(run, "value long, seg long, wins array<int>")


def hashed_windows(bodies: DataFrame, span: int) -> DataFrame:
    """The same for anchor values with very many segments: windows meet by hash, a row each."""
    def run(batches):
        for batch in batches:
            value, seg, place = (batch.column(k).to_numpy() for k in (0, 1, 2))
            for c in chunks(batch.column(3)):
                windows = (place[c.first:c.first + c.n] >> 10) & 1023
                owner = np.repeat(np.arange(c.n), windows)
                win = ragged(np.zeros(c.n, np.int64), windows)
                at = c.off[owner] + win
                rows = c.first + owner
                yield pa.RecordBatch.from_arrays([pa.array(value[rows]), pa.array(seg[rows]), pa.array(win), pa.array(c.hashes(at, at + span).view(np.int64))],
                                                 names=["value", "seg", "win", "h"])

    rows = bodies.dropDuplicates(["value", "seg"]).select("value", "seg", "place", "body").mapInArrow(run, "value long, seg long, win long, h long")
    rows = stage(rows, "windows")
    twice = rows.groupBy("value", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(twice, ["value", "h"]).groupBy("value", "seg").agg(F.transform(F.sort_array(F.collect_set("win")), lambda w: w.cast("int")).alias("wins"))


def _bodies(texts: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """value, seg, place, hot, body of the segments in ``wanted``, cut from their texts; copies of a text may give a row twice."""
    lists = wanted.groupBy("tkey").agg(F.collect_list(F.struct("value", "seg", "place", "hot")).alias("list"))

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            rows = pa.array(np.flatnonzero(new))
            lists, texts = batch.column(2).take(rows), batch.column(1).take(rows)
            items, count = lists.flatten(), lists.value_lengths().to_numpy()
            behind = np.concatenate([[0], np.cumsum(count)])
            place = items.field("place").to_numpy()
            for c in chunks(texts):
                a, b = int(behind[c.first]), int(behind[c.first + c.n])
                p = place[a:b]
                size = ((p >> 10) & 1023) + span - 1
                start = c.off[np.repeat(np.arange(c.n), count[c.first:c.first + c.n])] + (p >> 20)
                off = np.concatenate([[0], np.cumsum(size)])
                body = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(off), pa.py_buffer(c.data[ragged(start, size)])]).cast(pa.binary())
                part = items.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.field(k) for k in ("value", "seg", "place", "hot")), body], names=["value", "seg", "place", "hot", "body"])

    return texts.join(lists, "tkey").select("tkey", "text", "list").mapInArrow(run, "value long, seg long, place long, hot boolean, body binary")


def spans_by_text(texts: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """tkey, list of (place, seg, wins): segments with repeated windows of each text (wins null: all of them)."""
    every = stage(segment_rows(texts.where(F.octet_length("text") >= span), span, gram), "segments")
    # sums are taken before the shuffle; both sides of the joins are stored, so that Spark may split them: a value that a
    # third of all segments share is no one's task
    values = stage(every.groupBy("value").agg(F.sum("c").alias("total"), F.min("seg").alias("lo"), F.max("seg").alias("hi")).where("total > 1"), "values")
    met = stage(every.join(values, "value").select("value", "seg", "tkey", "place", "c", (F.col("lo") != F.col("hi")).alias("differ")), "met")
    drop_stage(every)
    kinds = met.groupBy("value", "seg").agg(F.sum("c").alias("n"), F.max("differ").alias("differ"))
    differ = kinds.where("differ").groupBy("value").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("least = 1")
    flags = stage(kinds.join(differ, "value", "left").select(
        "value", "seg", (F.col("n") > 1).alias("twice"), F.col("kinds").isNotNull().alias("mixed"),
        (F.coalesce("kinds", F.lit(0)) > (HOT if hot is None else hot)).alias("hot")), "flags")
    found = stage(met.drop("c", "differ").join(flags, ["value", "seg"]), "repeats")
    drop_stage(met)
    whole = found.where("twice").select("tkey", "place", "seg", F.lit(None).cast("array<int>").alias("wins"))
    wanted = (found.where("mixed").groupBy("value", "seg").agg(F.min(F.struct("tkey", "place")).alias("at"), F.max("hot").alias("hot"))
              .select("value", "seg", "at.*", "hot"))
    bodies = stage(_bodies(texts, wanted, span), "bodies")
    part = repeated_windows(bodies.where("NOT hot"), span, gram).unionByName(hashed_windows(bodies.where("hot"), span))
    part = found.where("mixed AND NOT twice").join(part, ["value", "seg"]).select("tkey", "place", "seg", "wins")
    return whole.unionByName(part).groupBy("tkey").agg(F.collect_set(F.struct("place", "seg", "wins")).alias("list"))


def _covered(c: Chunk, owner: np.ndarray, place: np.ndarray, seg: np.ndarray, wins: pa.Array, span: int) -> np.ndarray:
    """Which bytes of a chunk do the repeated windows cover; a segment that its text doesn't hold (a chance key) is passed over."""
    windows, start = (place >> 10) & 1023, c.off[owner] + (place >> 20)
    ok = start + windows + span - 1 <= c.off[owner + 1]
    ok[ok] = c.hashes(start[ok], (start + windows + span - 1)[ok]) == seg[ok]
    null = wins.is_null().to_numpy(zero_copy_only=False)
    count = np.where(null, 0, wins.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    each = np.repeat(np.arange(len(place)), count)
    one = start[each] + wins.flatten().to_numpy(zero_copy_only=False)
    one = one[ok[each]]
    whole = ok & null
    n = len(c.data) + 1
    edge = np.bincount(np.concatenate([one, start[whole]]), minlength=n) - np.bincount(np.concatenate([one + span, (start + windows + span - 1)[whole]]), minlength=n)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(df: DataFrame, keep: list[str], text: str = "text", span: int = SPAN, gram: int = GRAM, kept_text: bool = False, hot: int | None = None) -> DataFrame:
    """``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256 (and kept, as text) of every row.

    Each byte inside a ``span``-byte string that also starts elsewhere, in any row, goes;
    strings are judged on the input. Null texts are empty; repeated rows remove each
    other's long texts; texts shorter than ``span`` stay. kept leaves out what a cut
    leaves of a character. An empty table gives an empty result; ``keep`` must not clash
    with the new names or _tkey, _text and _list; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*keep, body.alias("_text"), F.xxhash64(utf8(text)).alias("_tkey"))
    found = spans_by_text(rows.select(F.col("_tkey").alias("tkey"), F.col("_text").alias("text")), span, gram, hot)
    joined = rows.join(found.select(F.col("tkey").alias("_tkey"), F.col("list").alias("_list")), "_tkey", "left").select(*keep, "_text", "_list")
    new = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * kept_text
    schema = T.StructType([df.schema[k] for k in keep] + list(T.StructType.fromDDL(new)))
    width = len(keep)

    def run(batches):
        for batch in batches:
            lists = batch.column(width + 1)
            count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            items, behind = lists.flatten(), np.concatenate([[0], np.cumsum(count)])
            place, seg = items.field("place").to_numpy(), items.field("seg").to_numpy().view(U64)
            for c in chunks(batch.column(width)):
                a, b = int(behind[c.first]), int(behind[c.first + c.n])
                owner = np.repeat(np.arange(c.n), count[c.first:c.first + c.n])
                gone = _covered(c, owner, place[a:b], seg[a:b], items.field("wins").slice(a, b - a), span)
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                edge = c.off[:-1][c.off[:-1] < len(gone)]
                begins[edge] = gone[edge]
                removed = sums(gone, c.off)
                left, off = c.data[~gone], c.off - np.concatenate([[0], np.cumsum(removed)])
                raw = [left[x:y].tobytes() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                out = [pa.array(np.diff(c.off)), pa.array(removed), pa.array(sums(begins, c.off)), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())]
                if kept_text:
                    out.append(pa.array([r.decode("utf-8", "ignore") for r in raw], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(c.first, c.n) for i in range(width)] + out, names=schema.names)

    return joined.mapInArrow(run, schema)


def op8_column_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that occur twice."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


QUERIES = {"op8_column_suffixes": op8_column_suffixes}
