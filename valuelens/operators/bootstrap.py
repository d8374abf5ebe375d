"""Paired bootstrap comparison of a model score against a baseline (G11).

Per iteration ``it`` (0..B-1) n draws with replacement pick row
``hash(seed, it, draw) mod n`` (xxhash64 by default; md5 on request so that an
SQL engine can reproduce the resamples).  Every metric is a *weighted* statistic
over the drawn rows, w(it, row) being a row's multiplicity:

  WAPE        Σw|y-s| / Σw|y|
  top-k       rows in score order (key tiebreak), each repeated w times; the first
              k = max(1, ceil(n f)) copies are kept: Σ y·clamp(k - C_before, 0, w)
  Spearman    tie-averaged ranks in the resample, W(<v) + (W(=v)+1)/2, then a
              weighted Pearson correlation (0 when a side is constant); ranks are
              taken from their mean, which is (n+1)/2 in every resample

The draws move once, packed as runs of small offsets for an iteration and a block, and become
one packed vector of B + 1 multiplicities per row (column 0 is the unit weight, whose
statistics are the point estimates).  From there on n rows move, each with its vector:
once into blocks of positions of the actual value, where the ranks are added as a second
vector, and once into blocks of either score, where a block gives its share of each sum
for each iteration.  Per order, one exchange serves both the blocks' totals and the rows.
Positions and tie groups are those of the rows and are found once; a table of (iteration,
block) holds the weight ahead of each block and the tie groups that cross its borders, so
neither an iteration nor a value that half of the rows share has to fit in one task.  A
block holds at most ``BLOCK_CELLS`` multiplicities.  What moves is squeezed (zstd): multiplicities,
the gaps between the offsets of a run, and the upper bytes of the ranks' distances take a few bits each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_index
from ..session import default_parallelism, materialize
from .ranking import global_rank, tie_spans

METRICS = ["spearman_difference", "top_10_capture_difference", "top_20_capture_difference", "wape_difference"]

#: Rows x iterations of one block: bounds a task's memory (some 16 MB for each matrix of 64-bit numbers).
BLOCK_CELLS = 2_000_000
#: Draws that a task packs at once.
PACKED_DRAWS = 2_000_000
_COUNTS = (np.dtype("u1"), np.dtype("<u2"))
_FRACTIONS = (0.10, 0.20)
_SUMS = ["sxy", "sxx", "syy", "cap10", "cap20", "wy", "wabs", "wdiff"]
_RANGES = ["ylo", "yhi", "slo", "shi"]


def _draw_hash(kind: str, seed: int) -> Column:
    if kind == "md5":
        return hash_index(F.lit(seed), "it", "draw")
    return F.xxhash64(F.lit(seed), "it", "draw")


def _squeezed(cells: list[bytes], width: int) -> pa.Array:
    """Cells of numbers of one or more bytes each, ``width`` of them; squeezed, after the bytes of a number, where that takes less than a byte each."""
    zstd, out = pa.Codec("zstd", compression_level=1), []
    for x in cells:
        z = bytes([len(x) // width]) + zstd.compress(x, asbytes=True)
        out.append(z if len(z) < width else x)
    return pa.array(out, pa.binary())


def _whole(column: pa.ChunkedArray, width: int) -> list[bytes]:
    """The cells of ``_squeezed``."""
    zstd = pa.Codec("zstd")
    return [x if len(x) >= width else zstd.decompress(x[1:], x[0] * width, asbytes=True) for x in column.to_pylist()]


def _weights(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Multiplicities, one byte each or two where a row of the block is drawn more than 255 times."""
    cells = _whole(column, width)
    if all(len(x) == width for x in cells):
        return np.frombuffer(b"".join(cells), _COUNTS[0]).reshape(len(cells), -1).astype(np.int64)
    return np.stack([np.frombuffer(x, _COUNTS[int(len(x) > width)]) for x in cells]).astype(np.int64)


def _packed_distances(distance: np.ndarray, wide: str) -> pa.Array:
    """Column 0 in full, and how far the other columns are from it: two bytes each where all of a row fit, else as ``wide``."""
    first, rest = distance[:, :1], distance[:, 1:] - distance[:, :1]
    fits = (np.abs(rest) <= np.iinfo(np.int16).max).all(1)
    return pa.array([a.astype("<i8").tobytes() + r.astype("<i2" if f else wide).tobytes() for a, r, f in zip(first, rest, fits, strict=True)], pa.binary())


def _squeezed_distances(column: pa.Array, width: int) -> pa.Array:
    """Distances of two bytes each with all lower bytes first and the upper ones squeezed, where that is shorter."""
    short, zstd, out = 8 + 2 * (width - 1), pa.Codec("zstd", compression_level=1), []
    for x in column.to_pylist():
        if len(x) == short:
            low, up = np.frombuffer(x, np.uint8, offset=8).reshape(-1, 2).T
            z = x[:8] + low.tobytes() + zstd.compress(up.tobytes(), asbytes=True)
            x = z if len(z) < short else x
        out.append(x)
    return pa.array(out, pa.binary())


def _whole_distance(x: bytes, width: int, zstd: pa.Codec) -> bytes:
    if len(x) >= 8 + 2 * (width - 1):
        return x
    both = np.empty((width - 1, 2), np.uint8)
    both[:, 0] = np.frombuffer(x, np.uint8, width - 1, 8)
    both[:, 1] = np.frombuffer(zstd.decompress(x[7 + width:], width - 1, asbytes=True), np.uint8)
    return x[:8] + both.tobytes()


def _distances(column: pa.ChunkedArray, width: int, wide: str) -> np.ndarray:
    short, zstd = 8 + 2 * (width - 1), pa.Codec("zstd")
    rows = [_whole_distance(x, width, zstd) for x in column.to_pylist()]
    first = np.array([np.frombuffer(x, "<i8", 1)[0] for x in rows], np.int64)
    rest = np.stack([np.frombuffer(x, "<i2" if len(x) == short else wide, width - 1, 8) for x in rows]).astype(np.int64)
    return np.concatenate([first[:, None], rest + first[:, None]], 1)


def _squeezed_run(offsets: np.ndarray) -> bytes:
    """Ascending offsets as squeezed gaps, after their number and the bytes of a gap."""
    gaps = np.diff(offsets, prepend=offsets.dtype.type(0))
    size = 1 if gaps.max() <= 255 else offsets.itemsize
    return np.array([len(gaps), size], "<u4").tobytes() + pa.Codec("zstd", compression_level=1).compress(gaps.astype(f"<u{size}").tobytes(), asbytes=True)


def _whole_run(x: bytes) -> np.ndarray:
    n, size = np.frombuffer(x, "<u4", 2).tolist()
    return np.frombuffer(pa.Codec("zstd").decompress(x[8:], n * size, asbytes=True), f"<u{size}").cumsum(dtype=np.int64)


def _packed_draws(draws: DataFrame, block: int, squeezed: bool = False) -> DataFrame:
    """_blk, it, offs: the offsets in the block of an iteration's draws, ascending and packed, from draws (it, _row)."""
    kind = np.dtype("<u2" if block <= 1 << 16 else "<u4")

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy().astype(np.int64) for k in (0, 1)])
            n += batch.num_rows
            if n >= PACKED_DRAWS:
                yield from out(held)
                held, n = [], 0
        yield from out(held)

    def out(held):
        if not sum(len(h[0]) for h in held):
            return
        it, row = (np.concatenate(x) for x in zip(*held, strict=True))
        end = int(row.max()) + 1
        it, row = np.divmod(np.sort(it * end + row), end)
        blk, off = row // block, (row % block).astype(kind)
        first = np.flatnonzero(np.r_[True, (it[1:] != it[:-1]) | (blk[1:] != blk[:-1])])
        for a in range(0, len(first), 10_000):
            f = first[a:a + 10_000]
            cut = np.append(f, first[a + 10_000] if a + 10_000 < len(first) else len(it))
            runs = [off[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
            offs = pa.array([_squeezed_run(x) if squeezed else x.tobytes() for x in runs], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(blk[f], pa.int32()), pa.array(it[f], pa.int32()), offs], names=["_blk", "it", "offs"])

    return draws.mapInArrow(pack, "_blk int, it int, offs binary")


def _multiplicities(rows: DataFrame, draws: DataFrame, iterations: int, block: int) -> DataFrame:
    """rows with ``w``: the packed multiplicities of each row, column 0 being 1."""
    kept = [c for c in rows.columns if c != "_rid"]
    width = iterations + 1

    def count(drawn: pa.Table, mine: pa.Table) -> pa.Table:
        place = (mine["_rid"].to_numpy() - 1) % block
        weights = np.zeros((block, width), np.int64)
        for it, x in zip(drawn["it"].to_pylist(), drawn["offs"].to_pylist(), strict=True):
            np.add.at(weights[:, it + 1], _whole_run(x), 1)
        most = weights.max(initial=0)
        if most > np.iinfo(_COUNTS[1]).max:
            raise OverflowError("a row is drawn too often for a packed multiplicity")
        weights[:, 0] = 1
        return mine.select(kept).append_column("w", _squeezed([x.tobytes() for x in weights.astype(_COUNTS[int(most > 255)])[place]], width))

    left = _packed_draws(draws, block, squeezed=True).groupBy("_blk")
    right = rows.withColumn("_blk", F.floor((F.col("_rid") - 1) / F.lit(block)).cast("int")).groupBy("_blk")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    return left.cogroup(right).applyInArrow(count, f"{schema}, w binary")


def _block_offsets(blocked, c: str, block: int, width: int) -> DataFrame:
    """_blk, it, off, hs, he, ts, te: what a block of positions needs of the blocks beside it.

    off is the weight ahead of the block; (hs, he) are the weight ahead of the tie group that
    enters the block from before and that group's whole weight, (ts, te) those of the group
    that starts in the block and leaves it.  iterations x blocks rows.
    """
    def totals(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        blk = key[0].as_py()
        first, last = part[f"f{c}"].to_numpy(), part[f"l{c}"].to_numpy()
        weights = _weights(part["w"], width)
        head = first < blk * block + 1
        tail = ~head & (last > (blk + 1) * block)

        def across(rows):
            return pa.array([int(first[rows][0])] * width if rows.any() else [None] * width, pa.int64())

        return pa.table({"_blk": pa.array([blk] * width, pa.int64()), "it": pa.array(np.arange(-1, width - 1), pa.int32()),
                         "tot": weights.sum(0), "head": weights[head].sum(0), "tail": weights[tail].sum(0),
                         "head_f": across(head), "tail_f": across(tail)})

    sums = blocked.applyInArrow(totals, "_blk bigint, it int, tot bigint, head bigint, tail bigint, head_f bigint, tail_f bigint")
    ahead = Window.partitionBy("it").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("off", F.coalesce(F.sum("tot").over(ahead), F.lit(0)))
    cross = sums.select("it", "_blk", F.explode(F.array(
        F.struct(F.lit("h").alias("end"), F.col("head_f").alias("f"), F.col("head").alias("part"), F.col("off").alias("before")),
        F.struct(F.lit("t").alias("end"), F.col("tail_f").alias("f"), F.col("tail").alias("part"),
                 (F.col("off") + F.col("tot") - F.col("tail")).alias("before")))).alias("_t"))
    cross = cross.select("it", "_blk", "_t.*").where("f IS NOT NULL")
    whole = Window.partitionBy("it", "f")
    ties = cross.withColumns({"eq": F.sum("part").over(whole), "start": F.min("before").over(whole)}).groupBy("it", "_blk").agg(
        *[F.max(F.when(F.col("end") == end, F.col(v))).alias(n) for end, v, n in
          (("h", "start", "hs"), ("h", "eq", "he"), ("t", "start", "ts"), ("t", "eq", "te"))])
    return sums.select("_blk", "it", "off").join(ties, ["it", "_blk"], "left")


def _in_blocks(rows: DataFrame, c: str, block: int):
    return rows.withColumn("_blk", F.floor((F.col(f"p{c}") - 1) / F.lit(block)).cast("bigint")).groupBy("_blk")


def _block_ranks(part: pa.Table, beside: pa.Table, c: str, block: int, n: int, width: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The block's rows by position, their weights, the weight ahead of each, and twice the distance of
    each tie-averaged position from the mean position."""
    part, beside = part.sort_by(f"p{c}"), beside.sort_by("it")
    weights = _weights(part["w"], width)
    side = {k: np.nan_to_num(beside[k].to_numpy()).astype(np.int64) for k in ("off", "hs", "he", "ts", "te")}
    before = np.cumsum(weights, 0) - weights + side["off"]
    first, last, blk = part[f"f{c}"].to_numpy(), part[f"l{c}"].to_numpy(), part["_blk"][0].as_py()
    starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    ahead, equal = before[starts], np.add.reduceat(weights, starts, 0)
    if first[0] < blk * block + 1:
        ahead[0], equal[0] = side["hs"], side["he"]
    elif last[0] > (blk + 1) * block:
        ahead[0], equal[0] = side["ts"], side["te"]
    if len(starts) > 1 and last[-1] > (blk + 1) * block:
        ahead[-1], equal[-1] = side["ts"], side["te"]
    distance = 2 * ahead + equal - n
    return part, weights, before, np.repeat(distance, np.diff(np.r_[starts, len(first)]), 0)


def _with_actual_ranks(rows: DataFrame, block: int, n: int, width: int | None = None) -> DataFrame:
    """rows with ``dy``, the packed distances of the actual value's ranks.

    Without ``width``, the weights of the shortest ``w`` have one byte each.
    """
    width = rows.agg(F.min(F.length("w"))).first()[0] if width is None else width
    kept = ["y", "m", "b", "pm", "fm", "lm", "pb", "fb", "lb", "w"]
    dtype = "<i4" if n < 2**29 else "<i8"

    def ranks(part: pa.Table, beside: pa.Table) -> pa.Table:
        part, _, _, distance = _block_ranks(part, beside, "y", block, n, width)
        return part.select(kept).append_column("dy", _squeezed_distances(_packed_distances(distance, dtype), width))

    blocked = _in_blocks(rows, "y", block)
    schema = "y double, m double, b double, pm bigint, fm bigint, lm bigint, pb bigint, fb bigint, lb bigint, w binary, dy binary"
    return blocked.cogroup(_block_offsets(blocked, "y", block, width).groupBy("_blk")).applyInArrow(ranks, schema)


def _score_sums(rows: DataFrame, c: str, block: int, n: int, width: int) -> DataFrame:
    """it and, summed over the rows, what the metrics of score ``c`` (best first) need."""
    dtype = "<i4" if n < 2**29 else "<i8"

    def sums(part: pa.Table, beside: pa.Table) -> pa.Table:
        part, weights, before, distance = _block_ranks(part, beside, c, block, n, width)
        y, s = part["y"].to_numpy(), part[c].to_numpy()
        dx, dy, w = -distance.astype(np.float64), _distances(part["dy"], width, dtype).astype(np.float64), weights.astype(np.float64)
        out = {"it": pa.array(np.arange(-1, w.shape[1] - 1), pa.int32()),
               "sxy": np.einsum("ij,ij,ij->j", w, dx, dy), "sxx": np.einsum("ij,ij,ij->j", w, dx, dx),
               "syy": np.einsum("ij,ij,ij->j", w, dy, dy)}
        for name, f in zip(("cap10", "cap20"), _FRACTIONS):
            out[name] = y @ np.clip(max(1.0, np.ceil(n * f)) - before, 0, weights)
        out |= {"wy": y @ w, "wabs": np.abs(y) @ w, "wdiff": np.abs(y - s) @ w}
        drawn = weights > 0
        for lo, hi, v in (("ylo", "yhi", y), ("slo", "shi", s)):
            out[lo] = np.where(drawn, v[:, None], np.inf).min(0)
            out[hi] = np.where(drawn, v[:, None], -np.inf).max(0)
        return pa.table(out)

    blocked = _in_blocks(rows.select("y", c, f"p{c}", f"f{c}", f"l{c}", "w", "dy"), c, block)
    schema = "it int, " + ", ".join(f"{x} double" for x in [*_SUMS, *_RANGES])
    parts = blocked.cogroup(_block_offsets(blocked, c, block, width).groupBy("_blk")).applyInArrow(sums, schema)
    return parts.groupBy("it").agg(*[F.sum(x).alias(x) for x in _SUMS], F.min("ylo").alias("ylo"), F.max("yhi").alias("yhi"),
                                   F.min("slo").alias("slo"), F.max("shi").alias("shi"))


def _metrics(sums: DataFrame, suffix: str) -> DataFrame:
    """it, wape, spearman and captures of one score."""
    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    const = (F.col("ylo") == F.col("yhi")) | (F.col("slo") == F.col("shi"))
    pearson = F.coalesce(F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy")), F.lit(0.0))
    return sums.select("it", share("wdiff", "wabs").alias(f"wape{suffix}"),
                       F.when(const, F.lit(0.0)).otherwise(pearson).alias(f"spearman{suffix}"),
                       share("cap10", "wy").alias(f"cap10{suffix}"), share("cap20", "wy").alias(f"cap20{suffix}"))


def paired_bootstrap(df: DataFrame, actual: str, model: str, baseline: str, key_cols: Sequence[str],
                     iterations: int = 1000, seed: int = 42, confidence: float = 0.95,
                     block_rows: int | None = None, draw_hash: str = "xxhash64") -> DataFrame:
    """(metric, estimate, ci_lower, ci_upper, confidence, probability_model_better,
    favorable_direction); differences are model - baseline.

    ``block_rows``: positions of a block; by default ``BLOCK_CELLS`` multiplicities.
    ``draw_hash``: "xxhash64" (fast, default) or "md5" (slower; reproducible by an
    SQL engine, used by the oracle-checked query)."""
    if draw_hash not in ("xxhash64", "md5"):
        raise ValueError("draw_hash must be 'xxhash64' or 'md5'")
    if int(iterations) < 1:
        raise ValueError("iterations must be at least 1")
    if not 0.0 < float(confidence) < 1.0:
        raise ValueError("confidence must lie inside (0, 1)")
    spark = df.sparkSession
    keys = list(key_cols)
    base = df.select(*keys, F.col(actual).cast("double").alias("y"), F.col(model).cast("double").alias("m"),
                     F.col(baseline).cast("double").alias("b"))
    rows = global_rank(base, keys, "_rid")          # dense row ids for the draws
    unfit = F.lit(False)
    for c in ("y", "m", "b"):
        unfit = unfit | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(unfit).alias("unfit")).first()
    n_rows = counted["n"]          # one scalar: sizes the draw range
    if n_rows == 0:
        raise ValueError("no rows to resample")
    if counted["unfit"]:
        raise ValueError(f"{counted['unfit']} rows hold null or non-finite values")
    B = int(iterations)
    block = int(block_rows or max(1, min(BLOCK_CELLS // (B + 1), -(-n_rows // default_parallelism(spark)))))
    total = B * n_rows
    parts = max(default_parallelism(spark), -(-total // 5_000_000))
    drawn = F.pmod(_draw_hash(draw_hash, int(seed)), F.lit(n_rows))
    draws = (spark.range(0, total, numPartitions=parts)
             .select(F.expr(f"id div {n_rows}").alias("it"), (F.col("id") % F.lit(n_rows)).alias("draw"))
             .select(F.col("it").cast("int").alias("it"), drawn.alias("_row")))
    for c, descending in (("y", False), ("m", True), ("b", True)):       # the orders are those of the rows, whatever the resample
        rows = tie_spans(rows, c, keys, f"p{c}", f"f{c}", f"l{c}", descending)
    weighted = materialize(_multiplicities(rows.drop(*keys), draws, B, block), "weights")
    ranked = materialize(_with_actual_ranks(weighted, block, n_rows, B + 1), "ranked")
    per_it = _metrics(_score_sums(ranked, "m", block, n_rows, B + 1), "_m").join(_metrics(_score_sums(ranked, "b", block, n_rows, B + 1), "_b"), "it")
    pairs = (("wape_difference", "wape"), ("spearman_difference", "spearman"), ("top_10_capture_difference", "cap10"),
             ("top_20_capture_difference", "cap20"))
    long = materialize(per_it.select("it", F.explode(F.array(*[
        F.struct(F.lit(metric).alias("metric"), (F.col(f"{c}_m") - F.col(f"{c}_b")).alias("v")) for metric, c in pairs])).alias("_kv"))
        .select("it", "_kv.metric", "_kv.v"), "resamples")
    alpha = (1.0 - float(confidence)) / 2.0
    lower_better = F.col("metric") == "wape_difference"
    stats = long.filter(F.col("it") >= 0).groupBy("metric").agg(
        F.percentile("v", F.lit(alpha)).alias("ci_lower"),
        F.percentile("v", F.lit(1.0 - alpha)).alias("ci_upper"),
        F.avg(F.when(F.col("metric") == "wape_difference", (F.col("v") < 0).cast("double"))
              .otherwise((F.col("v") > 0).cast("double"))).alias("probability_model_better"),
    )
    est = long.filter(F.col("it") == -1).select("metric", F.col("v").alias("estimate"))
    return est.join(stats, "metric", "inner").select(
        "metric", "estimate", "ci_lower", "ci_upper", F.lit(float(confidence)).alias("confidence"),
        "probability_model_better",
        F.when(lower_better, F.lit("negative")).otherwise(F.lit("positive")).alias("favorable_direction"))
