import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from valuelens.llm import quality_rules as Q
from valuelens.llm.textnum import chunks


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    cover = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(lines),
            len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t)), len(re.findall("[!?]", t)), len(set(w)),
            sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w), sum(bool(re.search(r"[#*$%&|<>]", x)) for x in lines)]


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tab#é中A!", max_size=60),
                           st.lists(st.sampled_from(["a", "b", "the", "\n"]), max_size=40).map(" ".join)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 80))
def test_counts_equal_plain_counts(texts, limit):
    got = []
    for c in chunks(pa.array(texts, pa.string()), limit):
        got += np.array(Q.text_counts(c)).T.tolist()
    assert got == [plain(t) for t in texts]


def test_em_finds_the_weak_rule():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.8
    votes = np.stack([np.where(rng.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) * (rng.random(4000) < 0.8)
                      for a in (0.95, 0.9, 0.9, 0.6)], 1)
    pattern, where, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, acc, q = Q.fit(pattern, n.astype(float))
    assert abs(prior - 0.8) < 0.06 and np.abs(acc - [0.95, 0.9, 0.9, 0.6]).max() < 0.05
    assert ((q[where.ravel()] > 0.5) == y).mean() > 0.95


def test_judge_cases(spark, docs):
    clean = ["word%d other%d thing%d here%d stays%d clean.\nline two%d of it%d reads well, too.\nand three%d" % ((i,) * 8) for i in range(30)]
    rows = list(enumerate(clean)) + [(100, "SPAM!! " * 60), (101, None), (102, ""), (103, clean[0]), (103, clean[0]), (None, "a b"), (104, "x" * 100000)]
    out = Q.judge(docs(rows).withColumnRenamed("lang", "kept_"), ["doc_id"]).collect()
    assert len(out) == len(rows)
    assert all(r.kept for r in out if r.doc_id is not None and r.doc_id < 30)
    assert not any(r.kept for r in out if r.doc_id in (100, 101, 102, 104, None))
    assert Q.judge(docs([]), ["doc_id"]).count() == 0
