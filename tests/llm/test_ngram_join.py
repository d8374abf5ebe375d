import re

import numpy as np

from valuelens.llm import ngram_join as J
from valuelens.llm.common import table


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    links, label = [set() for _ in rows], list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g]} - {i}:
            both = len(s & sets[j])
            if 10 * both >= 8 * (len(s) + len(sets[j]) - both):
                links[i].add(j)
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(links):
            low = min([label[i], *(label[j] for j in x)])
            if low < label[i]:
                label[i], changed = low, True
    return {rows[i][0]: (rows[label[i]][0], len(links[i]), len({rows[j][1] for j in links[i]} - {rows[i][1]})) for i in range(len(rows))}


def got(out):
    return {r.doc_id: (r.class_id, r.n_links, r.n_text_links) for r in out.collect()}


def corpus(rng, n=60, words=80):
    vocab = ["w%d" % i for i in range(500)]
    passage = rng.choice(vocab, 30).tolist()
    texts = []
    for i in range(n):
        w = rng.choice(vocab, int(rng.integers(6, words))).tolist()
        texts.append(" ".join(w))
        if i % 3 == 0:
            for _ in range(3):
                v = list(w)
                for k in rng.integers(0, len(v), max(1, len(v) // 60)):
                    v[k] = "x%d" % rng.integers(0, 99)
                texts.append(" ".join(v) + " ")
        if i % 4 == 0:
            texts.append(" ".join(passage + rng.choice(vocab, 60).tolist()))
        if i % 5 == 0:
            texts.append(texts[-1])
    return texts


def test_classes_and_links_equal_brute_force(spark, docs, monkeypatch):
    for name, value in (("BUCKET", 8), ("BLOCK", 16), ("BLOCK_TEXTS", 7), ("DENSE_BLOCK", 16)):
        monkeypatch.setattr(J, name, value)
    rng = np.random.default_rng(5)
    texts = corpus(rng)
    base = rng.choice(["q%d" % i for i in range(300)], 200).tolist()
    for k in range(40):  # a group larger than every block, of different texts
        v = list(base)
        v[k * 5] = "y%d" % k
        texts.append(" ".join(v))
    texts += ["", "  \n", "one two", "one  two", "one two three", "a b c d e", "x" * 30000]
    rows = list(enumerate(texts))
    df = docs(rows).withColumnsRenamed({"lang": "rec", "source": "component", "n_chars": "uid"})
    out, want = got(J.join_similar(df)), brute(rows)
    assert out == want


def test_nulls_repeats_and_empty_table(spark, docs):
    rows = [(1, None), (2, None), (3, "a b c d e f"), (3, "a b c d e f"), (None, "z"), (4, "")]
    out = J.join_similar(docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in out) == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 1), (3, 3, 1), (4, 4, 0)]
    assert J.join_similar(docs([])).count() == 0


def test_runs():
    assert J.runs_for(0.999, 1) == 7 and J.runs_for(0.999, 2) == 11


def test_isolated_pairs_of_shared_passages(spark, docs, monkeypatch):
    """Pairs whose every passage is in a fifth of all texts split down to the last level; 11 runs lose some of them."""
    monkeypatch.setattr(J, "BUCKET", 4)
    rng = np.random.default_rng(8)
    passages = [" ".join("p%dw%d" % (k, w) for w in range(30)) for k in range(60)]
    rows, pairs = [], 500
    for i in range(2000):
        chosen = np.sort(rng.choice(60, 11, replace=False))
        rows.append((2 * i, " ".join(passages[k] for k in chosen)))
        if i < pairs:  # 292 of 360 shingles are shared
            other = chosen.copy()
            other[5] = rng.choice(np.setdiff1d(np.arange(60), chosen))
            rows.append((2 * i + 1, " ".join(passages[k] for k in other)))
    out = {r.doc_id: r.class_id for r in J.join_similar(docs(rows)).collect()}
    assert len(out) == len(rows)
    assert sum(out[2 * i] != out[2 * i + 1] for i in range(pairs)) <= (1 - J.TARGET) * pairs


def test_isolated_pairs_among_texts_that_are_alike(spark, docs, monkeypatch):
    """Pairs at similarity 0.8 among texts that share most of their shingles with all others: dense paths, met at once."""
    monkeypatch.setattr(J, "BUCKET", 8)
    monkeypatch.setattr(J, "DENSE_BLOCK", 300)
    rng = np.random.default_rng(9)
    base = ["b%d" % i for i in range(420)]
    rows = []
    for i in range(800):  # 2 * 60 / 7 apart: alike in 0.75 of the shingles
        v = base + ["own%d_%d" % (i, k) for k in range(66)]
        rows.append((2 * i, " ".join(v)))
        if i < 100:
            rows.append((2 * i + 1, " ".join(v[:-1] + ["z"])))
    sized = []
    step = J.next_step
    monkeypatch.setattr(J, "next_step", lambda state, texts: sized.append(state.count()) or step(state, texts))
    out = {r.doc_id: r.class_id for r in J.join_similar(docs(rows)).collect()}
    assert all(out[2 * i] == out[2 * i + 1] for i in range(100)) and len(out) == len(rows)
    assert sum(sized) < 21 * len(rows)  # the group doesn't follow itself down


def test_dense_links_join_what_all_pairs_join():
    rng = np.random.default_rng(10)
    for _ in range(20):
        base = rng.integers(0, 2**31, (3, J.PLACES)) * 2
        sig = base[rng.integers(0, 3, 60)].astype(np.uint32)
        sig[rng.random(sig.shape) < rng.choice([0.1, 0.3, 0.5])] = rng.integers(0, 2**31) * 2
        sig[rng.random(sig.shape) < 0.05] = J._NONE
        dense = rng.random(60) < 0.5
        full = sig != J._NONE
        both = ((sig[:, None] == sig[None]) & full[:, None]).sum(2)
        near = (both >= 0.5 * (full[:, None] | full[None]).sum(2)) & (dense[:, None] | dense[None])
        i, j = np.nonzero(np.triu(near, 1))
        assert (J.forest(60, i, j) == J.forest(60, *J.dense_links(sig, dense, 0.5))).all()


def test_runs_reach_the_target_at_every_level():
    runs = J.runs_to_depth()
    assert max(J.missed(runs, level) for level in range(1, J.DEPTH + 1)) <= 1 - J.TARGET < J.missed(runs - 1)


def test_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    assert got(J.op3_chosen_path(spark, sf)) == brute(rows)
