import numpy as np
import pytest

import valuelens.llm.registry as R
from valuelens.llm import embedding_dedup as E
from valuelens.llm import graph as G
from valuelens.plans.oracle_check import compare, duckdb_connection


def plain(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(30)] + [(40, k) for k in range(41, 70)] + [tuple(map(int, rng.integers(70, 200, 2))) for _ in range(70)]
    want = plain(200, edges)
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got.get(i, i) == want[i] for i in range(200))
    assert G.forest(200, *np.array(edges).T).tolist() == want
    assert G.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute(vectors):
    x = np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    label = plain(len(x), np.argwhere(hit).tolist())
    return {k: (int(hit[i].sum()), vectors[label[i]][0]) for i, (k, _) in enumerate(vectors)}


def test_links_beyond_the_window(spark, monkeypatch):
    """A cluster far larger than the window, copies, a chain, and vectors that link with nothing."""
    monkeypatch.setattr(E, "BLOCK", 50)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [centre + rng.normal(size=16) * 0.12 for _ in range(180)] + [rng.normal(size=16) for _ in range(150)]
    rows += [rows[0]] * 5 + [[np.cos(a * 0.25), np.sin(a * 0.25)] + [0.0] * 14 for a in range(8)]
    vectors = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(rows)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, []), (1006, [1.0] * 3)]
    df = spark.createDataFrame([(*v, 0) for v in vectors + odd], "vec_id long, embedding array<float>, uid int")
    out = {r.vec_id: r for r in E.near_duplicates(df, window=8).collect()}
    want = brute(vectors)
    assert {k: (out[k].n_links, out[k].component_id) for k in want} == want
    assert all(out[k].n_links == 0 and out[k].component_id == k and out[k].kept for k, _ in odd)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])] * 3 + [(None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    out = E.near_duplicates(df).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in out) == [(0, 0), (1, 2), (1, 2), (1, 2)]
    assert E.near_duplicates(df.limit(0)).count() == 0


def clustered(n, pairs, cosine, mutual, dim=64, seed=0):
    """n vectors of one cluster; the first ``pairs`` have one partner each at ``cosine`` next to them."""
    rng = np.random.default_rng(seed)
    x = np.sqrt(1 - mutual) * E._unit(rng.normal(size=(n, dim))) + np.sqrt(mutual) * E._unit(rng.normal(size=(1, dim)))
    x = E._unit(x)
    a, o = x[:pairs], rng.normal(size=(pairs, dim))
    o = E._unit(o - (o * a).sum(1, keepdims=True) * a)
    x[pairs:2 * pairs] = cosine * a + np.sqrt(1 - cosine ** 2) * o
    return x.astype(np.float32)


def test_pairs_inside_a_dense_cluster(spark):
    """Isolated pairs among 20,000 vectors of mutual cosine 0.85, where one round of passes misses a tenth of them."""
    x = clustered(20_000, 500, 0.955, 0.85)
    unit = E._unit(x.astype(float))
    links = [int(k) - 1 for i in range(0, len(x), 2000) for k in (unit[i:i + 2000] @ unit.T >= 0.95).sum(1)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = {r.vec_id: r.n_links for r in E.near_duplicates(df).collect()}
    assert len(out) == len(x) and all(out[i] <= k for i, k in enumerate(links))
    assert sum(out.values()) >= 0.999 * sum(links)


def test_all_pairs_where_passes_cost_more(spark):
    """A table so small that a round compares as much as all pairs: nothing is left to chance."""
    x = clustered(1500, 200, 0.955, 0.9, dim=16)
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert E.candidates(df.selectExpr("vec_id AS uid", "16 AS dim", "CAST(embedding AS array<double>) AS embedding"), 0.95, 4, 48, 0.999) is None
    out = {r.vec_id: r.n_links for r in E.near_duplicates(df, passes=4, window=48).collect()}
    unit = E._unit(x.astype(float))
    assert [out[i] for i in range(len(x))] == ((unit @ unit.T >= 0.95).sum(1) - 1).tolist()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_oracle(spark, sf):
    ok, said = compare(spark, duckdb_connection(sf), sf, R.queries()["op7_sorted_projections"], R.oracle_sql()["op7_sorted_projections"])
    assert ok, said
