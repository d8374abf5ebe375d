"""N-gram Jaccard self-join along chosen paths.

A text is the set of its five-word shingles, embedded as the tokens (place, value) of a
one-permutation min-hash: two texts share about as many of their tokens as their
Jaccard similarity says. In a run, every text follows the tokens that a hash of run and
path chooses, 1 / LAMBDA of them on average; texts on one path share its tokens. Paths
with few texts are buckets whose pairs are compared at once. On a fuller path, the texts
whose tokens agree with the others' in DENSE of the places on average would only follow
each other down: they are compared with the whole path at once and leave it, and the rest
goes on, down to DEPTH tokens, where what is left is compared in blocks. Runs repeat until a similar pair
meets with the target probability even if its paths are full down to DEPTH, the spread of
the min-hash included.

Pairs of like tokens unite into candidate components. Their texts, each read once, are
then compared exactly, all pairs in blocks, so the number of links is exact inside a
component and no group is written out as pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, stage, table
from .graph import components, forest, in_units, into_blocks, pairs, whole_units
from .textnum import Chunk, U64, chunks, mix, shingles

LEAST, WIDTH = 0.8, 5
#: Places of the min-hash; share of its tokens that a step chooses, times the places; depth of paths.
PLACES, LAMBDA, DEPTH = 64, 0.8, 4
#: A path with more texts goes on; texts in a block of the deepest paths.
BUCKET, BLOCK = 64, 512
TARGET = 0.999
#: Pairs whose tokens agree less are not candidates: five standard deviations below LEAST.
CANDIDATE = 0.5
#: On a fuller path, texts that agree with it in so many places on average (as much as a candidate) are compared with all of it; texts in a block for that.
DENSE, DENSE_BLOCK = 0.5, 16384
#: Shingles and texts in a block of the exact comparison.
BLOCK_SHINGLES, BLOCK_TEXTS = 1_000_000, 512

_NONE = np.uint32(0xFFFFFFFF)


def _meets(level: int, share: float) -> float:
    """Probability that a pair which shares ``share`` chosen tokens a step, on average, meets at ``level`` in a run."""
    q = 1.0
    for _ in range(level):
        q = 1 - math.exp(-share * q)
    return q


def runs_for(target: float = TARGET, level: int = DEPTH, share: float = LEAST / LAMBDA) -> int:
    """Runs until a pair that shares ``share`` chosen tokens a step, on average, meets at ``level`` with probability ``target``."""
    return math.ceil(math.log(1 - target) / math.log(1 - _meets(level, share)))


def missed(runs: int, level: int = DEPTH, least: float = LEAST) -> float:
    """Share of pairs of similarity ``least`` that no run brings together at ``level``; a pair's shared places are binomial."""
    at = [(math.comb(PLACES, k) * least ** k * (1 - least) ** (PLACES - k), _meets(level, k / PLACES / LAMBDA)) for k in range(PLACES + 1)]
    return sum(p * (1 - q) ** runs for p, q in at)


def runs_to_depth(target: float = TARGET, least: float = LEAST) -> int:
    """Least runs with which ``target`` of the pairs of similarity ``least`` meet at DEPTH."""
    runs = runs_for(target, share=least / LAMBDA)
    while missed(runs, least=least) > 1 - target:
        runs += 1
    return runs


def signatures(c: Chunk) -> list:
    """Min-hash (PLACES little-endian uint32, all ones for a place without shingle) and number of shingles of each text."""
    start, end, first = c.words()
    h, at = shingles(c.hashes(start, end), first, WIDTH)
    h = mix(h ^ U64(0x5851F42D4C957F2D))
    out = np.full(c.n * PLACES, _NONE, np.uint32)
    place = np.repeat(np.arange(c.n) * PLACES, np.diff(at)) + (h >> U64(58)).astype(np.int64)
    np.minimum.at(out, place, ((h >> U64(20)) & U64(0xFFFFFFFE)).astype(np.uint32))
    raw = out.astype("<u4").tobytes()
    return [pa.array([raw[i:i + 4 * PLACES] for i in range(0, len(raw), 4 * PLACES)], pa.binary()), np.diff(at)]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, PLACES)


def _step(path: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and longer path of every token that the paths choose."""
    full = sig != _NONE
    token = mix((np.arange(PLACES, dtype=U64) << U64(32))[None] | sig.astype(U64))
    h = mix(token ^ path[:, None])
    limit = np.minimum(1.0, 1.0 / (LAMBDA * np.maximum(full.sum(1), 1)))
    row, col = np.nonzero(((h >> U64(11)).astype(np.float64) / (1 << 53) < limit[:, None]) & full)
    return row, mix(h[row, col] ^ U64(0xA0761D6478BD642F))


def first_step(texts: DataFrame, runs: int) -> DataFrame:
    """path, uid: every text on the paths of length one of all runs."""
    def run(batches):
        for batch in batches:
            uid, sig = batch.column(0), _matrix(batch.column(1))
            for k in range(runs):
                row, path = _step(mix(np.full(len(sig), k + 1, U64)), sig)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), uid.take(pa.array(row))], names=["path", "uid"])

    return texts.select("uid", "sig").mapInArrow(run, "path long, uid long")


def next_step(state: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of fuller paths, one token on."""
    def run(batches):
        for batch in batches:
            row, path = _step(batch.column(0).to_numpy().view(U64), _matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column(1).take(pa.array(row))], names=["path", "uid"])

    return state.join(texts.select("uid", "sig"), "uid").select("path", "uid", "sig").mapInArrow(run, "path long, uid long")


def agreement(sig: np.ndarray) -> np.ndarray:
    """Mean share of places in which each text agrees with the others."""
    n, total = len(sig), np.zeros(len(sig))
    for k in range(PLACES):
        _, at, count = np.unique(sig[:, k], return_inverse=True, return_counts=True)
        total += np.where(sig[:, k] != _NONE, count[at] - 1, 0)
    return total / np.maximum((sig != _NONE).sum(1), 1) / max(n - 1, 1)


def dense_links(sig: np.ndarray, dense: np.ndarray, candidate: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join whatever pairs of a dense text and another one join (tokens agree in ``candidate`` of the places).

    A component grows from a dense text; each of its dense texts is compared with the texts
    that are still outside, so texts that are alike are not compared with one another.
    """
    full, done, one, two = sig != _NONE, np.zeros(len(sig), bool), [], []
    for seed in np.flatnonzero(dense):
        if done[seed]:
            continue
        outside = np.arange(len(sig)) != seed
        queue = [seed]
        done[seed] = True
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(outside)
            near = rest[((sig[rest] == sig[x]) & full[x]).sum(1) >= candidate * (full[rest] | full[x]).sum(1)]
            outside[near] = False
            one.append(near)
            two.append(np.full(len(near), x))
            more = near[dense[near] & ~done[near]]
            done[more] = True
            queue += more.tolist()
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, int), np.zeros(0, int))


def dense_texts(fuller: DataFrame, texts: DataFrame) -> DataFrame:
    """path, uid, root, left of the texts on fuller paths: links of the dense ones, and whether a text leaves the path.

    A path of more than DENSE_BLOCK texts is dealt in pairs of blocks; a text leaves it if
    it is dense in all its pairs, and has met everyone on the path then.
    """
    units = into_blocks(fuller, "path", "uid", F.ceil(F.col("n") / DENSE_BLOCK))
    units = units.join(texts.select("uid", "sig"), "uid").select("path", "_lo", "_hi", "uid", "sig")

    def run(batches):
        for t, first in whole_units(batches, 3):
            uid, sig = t.column(3).to_numpy(), _matrix(t.column(4))
            root, left = uid.copy(), np.zeros(len(uid), bool)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                left[a:b] = agreement(sig[a:b]) >= DENSE
                i, j = dense_links(sig[a:b], left[a:b], CANDIDATE)
                root[a:b] = uid[a:b][forest(b - a, i, j)]
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.array(uid), pa.array(root), pa.array(left)], names=["path", "uid", "root", "left"])

    return in_units(units, ["path", "_lo", "_hi"], ["uid"]).mapInArrow(run, "path long, uid long, root long, left boolean")


def buckets(texts: DataFrame, runs: int) -> tuple[DataFrame, DataFrame]:
    """path, n, uid: texts on the paths where recursion ends, paths of one text left out; and uid, root: links of the dense texts of fuller paths."""
    state, out, links = first_step(texts, runs), None, None
    for level in range(1, DEPTH + 1):
        state = stage(state, "paths")
        n = state.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = stage(state.join(n, "path"), "paths")
        done = sized if level == DEPTH else sized.where(F.col("n") <= BUCKET)
        out = done if out is None else out.unionByName(done)
        fuller = sized.where(F.col("n") > BUCKET)
        if level == DEPTH or fuller.isEmpty():
            break
        met = stage(dense_texts(fuller, texts), "dense")
        own = met.where("uid <> root").select("uid", "root")
        links = own if links is None else links.unionByName(own)
        state = next_step(met.groupBy("path", "uid").agg(F.bool_and("left").alias("left")).where(~F.col("left")).select("path", "uid"), texts)
    return out, links


def candidates(bucketed: DataFrame, texts: DataFrame) -> DataFrame:
    """uid, root: a forest of the pairs in one bucket whose tokens agree in at least CANDIDATE of the places."""
    units = into_blocks(bucketed, "path", "uid", F.ceil(F.col("n") / F.when(F.col("n") <= BUCKET, BUCKET).otherwise(BLOCK)))
    units = units.join(texts.select("uid", "sig"), "uid").select("path", "_lo", "_hi", "_block", "uid", "sig")

    def run(batches):
        for t, first in whole_units(batches, 3):
            lo, hi, block, uid = (t.column(k).to_numpy() for k in (1, 2, 3, 4))
            sig = _matrix(t.column(5))
            left, right = [], []
            for i, j in pairs(first, block, lo, hi):
                either = ((sig[i] != _NONE) | (sig[j] != _NONE)).sum(1)
                both = ((sig[i] == sig[j]) & (sig[i] != _NONE)).sum(1)
                near = both >= CANDIDATE * either
                left.append(i[near])
                right.append(j[near])
            if left:
                same, low = np.unique(uid, return_index=True)  # a text on several paths is one node
                node = np.searchsorted(same, uid)
                root = forest(len(same), node[np.concatenate(left)], node[np.concatenate(right)])
                own = root != np.arange(len(same))
                yield pa.RecordBatch.from_arrays([pa.array(same[own]), pa.array(same[root[own]])], names=["uid", "root"])

    return in_units(units, ["path", "_lo", "_hi"], ["uid"]).mapInArrow(run, "uid long, root long")


def similar(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, least: float) -> np.ndarray:
    """one x two matrix: is the Jaccard similarity of the sets at least ``least``."""
    size = np.array([len(s) for s in sets])
    if len(one) * len(two) <= 64:
        both = np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in two] for i in one]).reshape(len(one), len(two))
    else:
        rows = np.union1d(one, two)
        owner = np.repeat(rows, size[rows])
        value, column, count = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        rank = np.full(len(value), -1)
        rank[shared] = np.arange(len(shared))
        column = rank[column.ravel()]
        owner, column = owner[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(one), len(two)))
        place = np.full((2, len(sets)), -1)
        place[0, one], place[1, two] = np.arange(len(one)), np.arange(len(two))
        for start in range(0, len(shared), 2048):
            a, b = np.searchsorted(column, (start, start + 2048))
            m = np.zeros((2, max(len(one), len(two)), 2048), np.float32)
            for k in (0, 1):
                mine = place[k, owner[a:b]]
                m[k, mine[mine >= 0], (column[a:b] - start)[mine >= 0]] = 1
            both += m[0, :len(one)] @ m[1, :len(two)].T
    union = size[one][:, None] + size[two][None] - both
    return both >= least * union - 1e-9


def exact_links(texts: DataFrame, least: float) -> DataFrame:
    """uid, text_links, doc_links, root of every text in a component, by units of two blocks.

    ``texts`` has component, uid, copies, n_shingles and text.
    """
    size = texts.groupBy("component").agg(F.sum("n_shingles").alias("_shingles"), F.count(F.lit(1)).alias("_texts"))
    rows = texts.join(size, "component").where("_texts > 1")
    units = into_blocks(rows, "component", "uid", F.greatest(F.ceil(F.col("_shingles") / BLOCK_SHINGLES), F.ceil(F.col("_texts") / BLOCK_TEXTS)))
    units = units.select("component", "_lo", "_hi", "_block", "uid", "copies", "text")

    def run(batches):
        for t, first in whole_units(batches, 3):
            lo, hi, block, uid, copies = (t.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
            out_text, out_doc, out_root = np.zeros(len(uid), np.int64), np.zeros(len(uid), np.int64), uid.copy()
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                sets = []
                for c in chunks(t.column(6).slice(a, b - a).combine_chunks()):
                    start, end, word = c.words()
                    h, at = shingles(c.hashes(start, end), word, WIDTH)
                    sets += [np.unique(h[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                one, two = np.flatnonzero(block[a:b] == lo[a]), np.flatnonzero(block[a:b] == hi[a])
                hit = similar(sets, one, two, least)
                if lo[a] == hi[a]:
                    np.fill_diagonal(hit, False)
                else:
                    out_text[a + two] += hit.sum(0)
                    out_doc[a + two] += copies[a + one] @ hit
                out_text[a + one] += hit.sum(1)
                out_doc[a + one] += hit @ copies[a + two]
                i, j = np.nonzero(hit)
                out_root[a:b] = uid[a:b][forest(b - a, one[i], two[j])]
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(out_text), pa.array(out_doc), pa.array(out_root)],
                                             names=["uid", "text_links", "doc_links", "root"])

    return in_units(units, ["component", "_lo", "_hi"], ["uid"]).mapInArrow(run, "uid long, text_links long, doc_links long, root long")


def join_similar(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, target: float = TARGET) -> DataFrame:
    """key, class_id, n_links, n_text_links of every row.

    class_id is the least key that links of at least ``least`` lead to. Equal texts are
    compared once: n_links counts the other rows linked, copies included, n_text_links
    the other distinct texts. A text of one to four words has one shingle, all of them;
    one without a word, or null, links with nothing and is its own class. Repeated rows
    are copies. An empty table gives an empty result; other columns are not read.
    """
    base = df.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("rec", F.unhex(F.md5(F.col("text").cast("binary"))))
    sketched = stage(map_texts(base.where(F.col("text").isNotNull()), "text", ["id", "rec"], "sig binary, n_shingles long", signatures)
                     .where("n_shingles > 0"), "sketches")
    texts = stage(sketched.groupBy("rec").agg(F.max("sig").alias("sig"), F.max("n_shingles").alias("n_shingles"), F.min("id").alias("least_id"),
                                              F.count(F.lit(1)).alias("copies")).withColumn("uid", F.monotonically_increasing_id()), "texts")
    bucketed, linked = buckets(texts, runs_to_depth(target, least))
    near = candidates(bucketed, texts)
    found = components(near if linked is None else near.unionByName(linked), "uid", "root")
    members = texts.select("uid", "rec", "least_id", "copies", "n_shingles").join(found.select(F.col("node").alias("uid"), "component"), "uid")
    # of equal texts the row with the least key is read; rows that repeat it are dropped behind the join
    read = (members.join(base.where(F.col("text").isNotNull()).withColumnsRenamed({"rec": "rec2"}), (F.col("rec") == F.col("rec2")) & F.col("least_id").eqNullSafe(F.col("id")))
            .select("component", "uid", "copies", "n_shingles", "text").dropDuplicates(["uid"]))
    checked = stage(exact_links(read, least), "text-links")
    united = components(checked, "uid", "root").select(F.col("node").alias("uid"), F.col("component").alias("head"))
    links = checked.groupBy("uid").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    known = (texts.select("uid", "rec", "least_id", "copies").join(links, "uid", "left").join(united, "uid", "left")
             .withColumn("head", F.coalesce("head", "uid")))
    heads = known.groupBy("head").agg(F.min("least_id").alias("class_id"))
    known = known.join(heads, "head").select("rec", "class_id", (F.coalesce("doc_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                             F.coalesce("text_links", F.lit(0)).alias("n_text_links"))
    worded = sketched.select("id", "rec").join(known, "rec").select("id", "class_id", "n_links", "n_text_links")
    zero = F.lit(0).cast("long")
    bare = base.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("id", F.col("id").alias("class_id"), zero.alias("n_links"), zero.alias("n_text_links"))
    return worded.unionByName(bare).withColumnRenamed("id", key)


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document at Jaccard similarity 0.8 of five-word shingles."""
    return join_similar(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_chosen_path": op3_chosen_path}
