import zlib

import numpy as np
from pyspark.sql import functions as F

from valuelens.llm import toxicity as X
from valuelens.llm.common import crc_fold


def test_windows_cover_the_text():
    rng = np.random.default_rng(0)
    for _ in range(50):
        t = bytes(rng.choice(list(b"ab \n"), int(rng.integers(0, 2000)), p=[0.5, 0.35, 0.1, 0.05]))
        assert b"".join(X.windows(t, 32)) == t
        assert all(0 < len(w) <= 128 for w in X.windows(t, 32))


def test_few_or_no_labels(spark, docs):
    df = docs([(1, "a b c"), (2, None), (3, ""), (3, ""), (None, "x" * 50000), (4, "you moron")]).withColumn("score", F.lit("z"))
    model = X.fit([], 0.1)
    out = X.score(df, model, ["doc_id"]).collect()
    assert len(out) == 6 and all(abs(r.score - 0.1) < 1e-9 for r in out)
    model = X.fit([(b"you moron", 1), (b"good day", 0)] * 8, 0.5)
    assert all(0 <= r.score <= 1 for r in X.score(df, model, ["doc_id"]).collect())
    assert X.score(docs([]), model, ["doc_id"]).count() == 0


def labelled(n, seed):
    """Invented prose; in the toxic texts a sixth of the words are of a rude vocabulary."""
    rng = np.random.default_rng(seed)
    letters = list("abcdefghijklmnoprstuvwz")
    words = ["".join(rng.choice(letters, int(rng.integers(2, 10)))) for _ in range(1200)]
    rude = ["".join(rng.choice(letters, int(rng.integers(5, 10)))) for _ in range(40)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        w = [rude[int(rng.integers(40))] if toxic and rng.random() < 1 / 6 else words[min(int(rng.exponential(250)), 1199)] for _ in range(int(rng.integers(60, 250)))]
        rows.append((i, " ".join(w), toxic))
    return rows


def test_held_out_accuracy(spark, docs, tmp_path):
    rows = labelled(2400, 3)
    docs([(i, t) for i, t, _ in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = X.op4_compression_distance(spark, str(tmp_path)).toPandas().set_index("doc_id")
    assert len(out) == len(rows)
    assert [bool(h) for h in out.loc[[i for i, *_ in rows], "held_out"]] == [zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows]
    toxic = np.array([t for *_, t in rows])[out.index[out.held_out]] == 1
    held = out[out.held_out]
    r = held.score.rank().to_numpy()
    auc = (r[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95, auc
    p = held.predicted.to_numpy()
    assert p[toxic].mean() > 0.75 and p[~toxic].mean() < 0.05, (p[toxic].mean(), p[~toxic].mean())
    assert (held.predicted == (held.score >= 0.3)).all()


def test_folds_of_null_keys(spark, docs):
    assert {r[0] for r in docs([(None, "a"), (None, "b")]).select(crc_fold("doc_id", 4)).collect()} == {0}
