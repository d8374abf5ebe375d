import hashlib
from collections import Counter

import numpy as np
import pytest

from valuelens.llm import suffix_dedup as S
from valuelens.llm.common import table


def brute(rows, span):
    texts = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(t[i:i + span] for _, t in texts for i in range(len(t) - span + 1))
    out = []
    for k, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - span + 1):
            if seen[t[i:i + span]] > 1:
                gone[i:i + span] = True
        gone = gone[:-1]
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((k or -1, len(t), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(out):
    return sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())


def corpus(rng, n=150):
    word = lambda: "".join(rng.choice(list("abcdéf"), int(rng.integers(1, 6))))
    passages = [" ".join(word() for _ in range(int(rng.integers(3, 30)))) for _ in range(6)]
    texts = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(int(rng.integers(0, 25)))) for _ in range(3)]
        if i % 2:
            parts.insert(int(rng.integers(0, 3)), passages[int(rng.integers(0, 6))])
        texts.append(" ".join(parts))
        if i % 7 == 0:
            t = list(texts[-1])
            if t:
                t[int(rng.integers(0, len(t)))] = "X"
            texts.append("".join(t))
        if i % 9 == 0:
            texts += [texts[-1]] * 2
    return texts + ["", None, "ab" * 300, "ab" * 40 + "c", "z" * 500, "z" * 45, "Q" * 19 + "R", "x\n" * 15000]


@pytest.mark.parametrize("hot", [None, 3])
def test_equals_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(S, "SLICE", 700)
    rows = list(enumerate(corpus(np.random.default_rng(4)), 1)) + [(None, "q" * 30)]
    df = docs(rows).withColumnsRenamed({"lang": "value", "source": "tkey", "n_chars": "list"})
    assert got(S.remove_repeats(df, ["doc_id"], span=40, gram=8, hot=hot)) == brute(rows, 40)


def test_kept_text_and_empty_table(spark, docs):
    shared = "é" * 150
    out = S.remove_repeats(docs([(1, "a" + shared), (2, shared + "b")]), ["doc_id"], kept_text=True).collect()
    assert sorted(r.kept for r in out) == ["a", "b"]
    assert S.remove_repeats(docs([]), ["doc_id"]).count() == 0


def test_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    fix = lambda rows: [(-1 if r[0] in (0, -1) else r[0], *r[1:]) for r in rows]
    assert sorted(fix(got(S.op8_column_suffixes(spark, sf)))) == sorted(fix(brute(rows, 200)))
