"""Near-duplicate embeddings by sorted projection passes.

Each pass orders the centred vectors lexicographically by the concatenated signs of random
projections and compares every vector with a bounded window of its successors; verified
pairs of all passes are united. Rounds of passes with fresh projections go on until a round
joins almost nothing more and fresh query vectors, compared with all rows, have their links
inside the components; where the vectors lie so close together that all pairs in blocks cost
less than more passes, these are compared. Inside the components so found every pair is then
verified in blocks, so that the number of links doesn't depend on the window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuelens.operators.ranking import global_rank

from .common import drop_stage, stage, table
from .graph import components, forest, in_units, into_blocks, whole_units

LEAST = 0.95
#: Passes in a round, signs in a pass's key, successors compared, and rows compared at once.
PASSES, SIGNS, WINDOW, ROWS = 16, 62, 64, 4096
#: Share of the queries' links that components must hold, and queries; a round that adds a tenth of the rest at most asks them.
TARGET, ASKED = 0.999, 2048
#: Pairs that a block compares in the time of one in a window (64 dimensions: 4.7 and 19 ns).
BLOCK_GAIN = 4
#: Vectors of a component in a block.
BLOCK = 1024


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim) if dim else flat.reshape(len(column), 0)


def projection_keys(x: np.ndarray, turn: int, signs: int = SIGNS) -> np.ndarray:
    """Signs of a pass's random projections of each row, first projection highest."""
    planes = np.random.default_rng([turn, x.shape[1]]).normal(size=(x.shape[1], signs))
    bits = (x @ planes > 0).astype(np.int64)
    return bits @ (np.int64(1) << np.arange(signs - 1, -1, -1, dtype=np.int64))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sample(rows: DataFrame, turn: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length of vectors the uids and unit vectors of ASKED rows in all, others for each ``turn``."""
    t = rows.select("dim", "uid", "embedding").orderBy(F.xxhash64("uid", F.lit(turn)), "uid").limit(ASKED).toArrow()
    dims = t.column(0).to_numpy()
    out = {}
    for dim in np.unique(dims).tolist():
        own = t.take(pa.array(np.flatnonzero(dims == dim)))
        out[dim] = own.column(1).to_numpy(), _unit(_matrix(own.column(2), dim))
    return out


def _keyed(distinct: DataFrame, turns: range, centres: dict[int, np.ndarray]) -> DataFrame:
    """Sign keys of unit vectors less their centre; a vector is carried as float32 if that holds it exactly."""
    schema = T.StructType.fromDDL("pass int, dim int, sign_key long, uid long, v binary")

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = pa.array(np.flatnonzero(dims == dim))
                uid, x = batch.column(0).take(rows), _matrix(batch.column(2).take(rows), dim)
                with np.errstate(over="ignore"):
                    half = x.astype(np.float32)
                raw = pa.array([r.tobytes() for r in (half if (half == x).all() else x)], pa.binary())
                x = _unit(x) - centres.get(dim, 0.0)
                for turn in turns:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), turn, np.int32)), pa.array(np.full(len(x), dim, np.int32)),
                                                      pa.array(projection_keys(x, turn)), uid, raw], names=schema.names)

    return distinct.select("uid", "dim", "embedding").mapInArrow(run, schema)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in column.to_pylist()], np.float64))


def window_links(keyed: DataFrame, window: int, least: float, rows: int = ROWS) -> DataFrame:
    """uid, root (stored): a forest of the pairs found in the windows of each run of ``rows`` ranks.

    The first ``window`` rows of a run also go to the run before, so windows cross runs.
    """
    ranked = global_rank(keyed, ["pass", "dim", "sign_key", "uid"])
    run = F.floor((F.col("rank") - 1) / rows)
    dealt = ranked.withColumn("run", F.explode(F.when((F.col("rank") - 1) % rows < window, F.array(run, run - 1)).otherwise(F.array(run)))).where("run >= 0")

    def find(batches):
        for t, first in whole_units(batches, 1):
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                g = t.slice(a, b - a)
                turn, dim, uid = (g.column(k).to_numpy() for k in (2, 3, 4))
                left, right = [], []
                for d in np.unique(dim).tolist():  # at most a few, side by side
                    own = np.flatnonzero(dim == d)
                    x, p = _vectors(g.column(5).take(pa.array(own)), d), turn[own]
                    for step in range(1, min(window, len(own) - 1) + 1):
                        hit = (np.einsum("ij,ij->i", x[:-step], x[step:]) >= least) & (p[:-step] == p[step:])
                        left.append(own[:-step][hit])
                        right.append(own[step:][hit])
                if left:
                    root = uid[forest(b - a, np.concatenate(left), np.concatenate(right))]
                    own = root != uid
                    yield pa.RecordBatch.from_arrays([pa.array(uid[own]), pa.array(root[own])], names=["uid", "root"])

    cols = in_units(dealt.select("run", "rank", "pass", "dim", "uid", "v"), ["run"], ["rank"])
    found = stage(cols.mapInArrow(find, "uid long, root long"), "window-links")
    drop_stage(ranked)
    return found


def query_links(rows: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], least: float) -> DataFrame:
    """uid, root, links, missed: the queries' links with all ``rows`` and how many of them lead out of a component.

    Counts have no uid; the other rows are a forest of the missed links.
    """
    asked = rows.sparkSession.createDataFrame([(int(u),) for uid, _ in queries.values() for u in uid], "uid long")
    home = {r.uid: r.component for r in rows.join(F.broadcast(asked), "uid").select("uid", "component").collect()}
    homes = {dim: np.array([home[u] for u in uid.tolist()]) for dim, (uid, _) in queries.items()}

    def ask(batches):
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in queries:
                    continue
                own = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(own))
                uid, component = part.column(1).to_numpy(), part.column(2).to_numpy()
                other, q = queries[dim]
                hit = (_unit(_matrix(part.column(3), dim)) @ q.T >= least) & (uid[:, None] != other[None])
                i, j = np.nonzero(hit & (component[:, None] != homes[dim][None]))
                both = np.concatenate([uid, other])
                root = both[forest(len(both), i, len(uid) + j)]
                own = root != both
                yield pa.RecordBatch.from_arrays([pa.array([None, *both[own].tolist()], pa.int64()), pa.array([None, *root[own].tolist()], pa.int64()),
                                                  pa.array([int(hit.sum())] + [0] * int(own.sum()), pa.int64()), pa.array([len(i)] + [0] * int(own.sum()), pa.int64())],
                                                 names=["uid", "root", "links", "missed"])

    return rows.select("dim", "uid", "component", "embedding").mapInArrow(ask, "uid long, root long, links long, missed long")


def candidates(distinct: DataFrame, least: float, passes: int, window: int, target: float) -> DataFrame | None:
    """node, component of the rows that rounds of passes link; None if comparing all pairs costs less than going on.

    A round after which hardly a component grew is not proof (its passes may rarely meet a
    pair in a dense run), so queries drawn anew must find ``target`` of their links too.
    """
    n, turn, rank, found = distinct.count(), 0, 0, None
    while 2 * window * turn * BLOCK_GAIN < n:
        queries = sample(distinct, turn)
        links = window_links(_keyed(distinct, range(turn, turn + passes), {dim: x.mean(0) for dim, (_, x) in queries.items()}), window, least)
        turn += passes
        found, before = _united(found, links), rank
        rank = found.where("node <> component").count()
        if rank - before > (1 - target) / 10 * rank:
            continue
        asked = stage(query_links(distinct.join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid")),
                                  queries, least), "query-links")
        total, missed = asked.agg(F.sum("links"), F.sum("missed")).first()
        if missed:
            found = _united(found, asked.where("uid IS NOT NULL").select("uid", "root"))
            rank = found.where("node <> component").count()
        if missed <= (1 - target) * total:
            return found
    return None


def _united(found: DataFrame | None, links: DataFrame) -> DataFrame:
    if found is not None:
        links = links.unionByName(found.select(F.col("node").alias("uid"), F.col("component").alias("root")))
    return stage(components(links, "uid", "root"), "components")


def block_links(members: DataFrame, least: float, block: int = BLOCK, few: bool = False) -> DataFrame:
    """uid, links (copies counted), root: exact links of all pairs in each component, by units of two blocks.

    ``few``: the components are so few that their sizes can go to every task.
    """
    size = members.groupBy("component", "dim").agg(F.count(F.lit(1)).alias("_size"))
    size = F.broadcast(size) if few else size
    rows = members.join(size, ["component", "dim"]).where("_size > 1")
    units = into_blocks(rows, "component", "uid", F.ceil(F.col("_size") / block)).select("component", "dim", "_lo", "_hi", "_block", "uid", "n", "embedding")

    def check(batches):
        for t, first in whole_units(batches, 4):
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                g = t.slice(a, b - a)
                dim, lo, hi = (g.column(k)[0].as_py() for k in (1, 2, 3))
                block_of, uid, n = (g.column(k).to_numpy() for k in (4, 5, 6))
                x = _matrix(g.column(7), dim)
                norm = np.linalg.norm(x, axis=1)
                one, two = np.flatnonzero(block_of == lo), np.flatnonzero(block_of == hi)
                hit = x[one] @ x[two].T / np.outer(norm[one], norm[two]) >= least
                links = np.zeros(b - a, np.int64)
                if lo == hi:
                    np.fill_diagonal(hit, False)
                else:
                    links[two] += hit.T @ n[one]
                links[one] += hit @ n[two]
                i, j = np.nonzero(hit)
                root = uid[forest(b - a, one[i], two[j])]
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(links), pa.array(root)], names=["uid", "links", "root"])

    return in_units(units, ["component", "dim", "_lo", "_hi"], ["uid"]).mapInArrow(check, "uid long, links long, root long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST, passes: int = PASSES,
                    window: int = WINDOW, target: float = TARGET) -> DataFrame:
    """key, n_links, component_id, kept of every row.

    Rounds of ``passes`` passes go on until the components hold ``target`` of the links.

    Equal vectors are compared once and count as linked copies. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and are their own
    component; vectors of different lengths never link. Repeated rows are copies. An
    empty table gives an empty result; other columns are not read.
    """
    base = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("embedding"))
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    distinct = stage(base.where(fine).groupBy("embedding").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"))
                     .withColumns({"uid": F.monotonically_increasing_id(), "dim": F.size("embedding")}), "vectors")
    found = candidates(distinct, least, passes, window, target)
    if found is None:
        checked = block_links(distinct.withColumn("component", F.lit(0).cast("long")), least, few=True)
    else:
        checked = block_links(distinct.join(found.select(F.col("node").alias("uid"), "component"), "uid"), least)
    checked = stage(checked, "vector-links")
    united = components(checked, "uid", "root").select(F.col("node").alias("uid"), F.col("component").alias("head"))
    links = checked.groupBy("uid").agg(F.sum("links").alias("links"))
    known = distinct.join(links, "uid", "left").join(united, "uid", "left").select(
        "embedding", "least_id", F.coalesce("head", "uid").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    heads = known.groupBy("head").agg(F.min("least_id").alias("component_id"))
    known = known.join(heads, "head").select("embedding", "n_links", "component_id")
    good = base.where(fine).join(known, "embedding").select("id", "n_links", "component_id")
    rest = base.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = {"op7_sorted_projections": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id"""}
QUERIES = {"op7_sorted_projections": op7_sorted_projections}
