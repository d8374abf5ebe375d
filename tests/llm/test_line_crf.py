import itertools

import numpy as np
import pyarrow as pa

from valuelens.llm import line_crf as L
from valuelens.llm.common import table
from valuelens.llm.textnum import chunks


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 3, 4, 8])
    e, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    p, pairs = L.marginals(e, trans, first)
    want, want_pairs = np.zeros(8), np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        every = list(itertools.product((0, 1), repeat=b - a))
        w = np.array([np.exp(sum(e[a + i] * y for i, y in enumerate(ys)) + sum(trans[u, v] for u, v in itertools.pairwise(ys))) for ys in every])
        w /= w.sum()
        for ys, q in zip(every, w):
            want[a:b] += q * np.array(ys)
            for u, v in itertools.pairwise(ys):
                want_pairs[u, v] += q
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_lines_and_neighbours():
    c = next(chunks(pa.array(["a b\n\nA!\n", None, "x"])))
    x, first, length = L.line_features(c)
    assert first.tolist() == [0, 4, 5, 6] and length.tolist() == [3, 0, 2, 0, 0, 1]
    assert (x[1, 17:34] == x[0, :17]).all() and (x[0, 34:51] == x[1, :17]).all() and (x[4, 17:51] == 0).all()


def test_cases(spark, docs):
    df = docs([(1, "a b c\n"), (2, None), (3, ""), (3, ""), (None, "x" * 50000), (4, "\n" * 3000)]).withColumnRenamed("lang", "score")
    model = L.fit([(b"Clean words are here.\nAnd more.", 1), (b"SPAM!! SPAM!!\nSPAM!!", 0)] * 20, 0.8)
    out = L.score(df, model, ["doc_id"]).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out) and next(r.n_lines for r in out if r.doc_id == 4) == 3001
    assert L.score(docs([]), model, ["doc_id"]).count() == 0
    assert abs(L.score(df, L.fit([], 0.4), ["doc_id"]).first().score - 0.4) < 1e-9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = L.op10_line_crf(spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    out = out[out.held_out]
    r, y = out.score.rank(), out.quality == 1
    auc = (r[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.97, auc
    assert out.predicted[y].mean() > 0.98 and out.predicted[~y].mean() < 0.25, (out.predicted[y].mean(), out.predicted[~y].mean())
