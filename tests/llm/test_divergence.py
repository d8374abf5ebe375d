import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuelens.llm import divergence as D


def plain(rows, top=200):
    """lang, source, part, item, value, rank by dictionaries; rows are lang, source, text."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [[w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[2])] for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, w) for (x, s, _), w in zip(rows, words) if x == lang]
        docs = Counter(t for _, w in mine for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= 3)
        groups = {s: Counter() for s, _ in mine}
        for s, w in mine:
            groups[s].update(t for t in w if docs[t] >= 3)
        every = sum(groups.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        share = {s: {t: p(c, t) for t in kept} for s, c in groups.items()}
        for s, c in groups.items():
            part = {"pair": [(sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o) for o in groups if o != s],
                    "term": [((share[s][t] - p(every, t)) ** 2 // p(every, t), t) for t in kept if c[t] and share[s][t] > p(every, t)]}
            for name, found in part.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, name, t, v, i + 1) for i, (v, t) in enumerate(found) if name == "pair" or i < top]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n=300, vocabulary=900):
    rng = random.Random(seed)
    letters = "abcdefgéß"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    rows = []
    for _ in range(n):
        s = rng.choice(["a", "a", "a", "b", "c", "", None])
        text = " ".join(words[min(int(rng.expovariate(1 / 120)) + (10 if s == "b" else 0), vocabulary - 1)] for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "de", None]), s, rng.choice([text, text.upper(), text.replace(" ", "-")])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_dictionaries(spark, seed, monkeypatch):
    for k, v in (("PART", 64), ("SOURCES", 2), ("SHARD", 100), ("SLICE", 7)):  # many partitions, blocks and shards
        monkeypatch.setattr(D, k, v)
    rows = corpus(seed) + [("en", "a", "hot hot hot")] * 150 + [("xx", "lonely", "once"), ("en", "mute", None), ("en", "long", "word " * 60_000), ("yy", "u", "one"), ("yy", "v", "one")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("z") for c in ("term", "n", "docs", "value", "rank")})
    assert found(D.audit(docs, top=20)) == plain(rows, 20)


def test_default_sizes(spark):
    rows = corpus(3, 200)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert found(D.audit(docs)) == plain(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert D.audit(docs).collect() == []
    assert found(D.audit(spark.createDataFrame([(None, None, None)], docs.schema))) == []


def test_skyband_keeps_whatever_fewer_than_k_dominate():
    rng = np.random.default_rng(0)
    for k in (1, 3, 10):
        high, low = rng.integers(0, 12, 3000), rng.integers(0, 12, 3000)
        name = rng.permutation(3000)
        n = ((high[None] >= high[:, None]) & (low[None] <= low[:, None]) & (name[None] < name[:, None])).sum(1)
        assert (D.in_skyband(high, low, name, k) == (n < k)).all()
