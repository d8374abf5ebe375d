import zlib

import numpy as np

from valuelens.llm import sharding as S


def test_rebalance_narrows_the_gap_and_is_an_edit():
    size = np.random.default_rng(1).lognormal(8, 1.5, 4096).astype(np.int64)
    start = S.first_map(16)
    new = S.rebalance(size, start, 16)
    load = np.bincount(new, size, 16)
    assert load.max() - load.min() <= 0.001 * load.mean()
    assert (new != start).mean() < 0.5
    grown = S.rebalance(size, new, 17)
    assert np.bincount(grown, size, 17).min() > 0


def test_shard_numbers_rows_and_balances(spark, docs):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(0, 300))) for i in range(900)] + [(None, "same"), (None, "same"), (7, "x"), (7, "x"), (901, None)]
    out = S.shard(docs(rows), shards=4, slots=256).collect()
    assert len(out) == len(rows)
    for k in range(4):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    load = [sum(r.size for r in out if r.shard == k) for k in range(4)]
    assert max(load) - min(load) <= 301
    r = next(r for r in out if r.doc_id == 901)
    assert r.size == 1 and r.text_crc32 == zlib.crc32(b"")
    assert len({r.vslot for r in out if r.doc_id == 7}) == 1


def test_map_versions_and_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    assert S.shard(docs([]), map_path=path).count() == 0
    assert S.load_map(spark, path, 0).count() == S.SLOTS
    assert [r.shard for r in S.load_map(spark, path).orderBy("vslot").collect()] == list(S.first_map(16))


def test_clashing_extra_columns(spark, docs):
    from pyspark.sql import functions as F
    df = docs([(1, "a"), (2, "bé")]).withColumns({c: F.lit("z") for c in ("vslot", "size", "shard", "slot", "base")})
    assert sorted((r.doc_id, r.size) for r in S.shard(df).collect()) == [(1, 2), (2, 4)]
