import hashlib
import re

import pytest
from pyspark.sql import functions as F

from valuelens.llm import fair_mix as M


def plain(rows):
    """id, size, source_size, target, taken by sorting everything in one list."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    budget, capped = sum(size), set()
    while True:
        rest = budget - sum(3 * total[s] for s in capped)
        left = sum(weight[s] for s in sources if s not in capped)
        over = {s for s in sources if s not in capped and 3 * total[s] * left <= weight[s] * rest}
        if not over:
            break
        capped |= over
    target = {s: float(3 * total[s]) if s in capped else rest * weight[s] / left for s in sources}
    queue = []
    for k, s in enumerate(sources):
        mine = sorted((hashlib.md5(f"{M.SEED}|{'' if r[0] is None else r[0]}|{n}".encode()).hexdigest()[:16], r[0] is not None, r[0] or 0, n, i)
                      for i, (n, r) in enumerate(zip(size, rows)) if r[2] == s)
        start = 0
        for _ in range(3):
            for *_, n, i in mine:
                if n and target[s]:
                    queue.append(((start + n) / target[s], k, start, n, i))
                start += n
    taken, spent = [0] * len(rows), 0
    for *_, n, i in sorted(queue):
        part = min(n, budget - spent)
        taken[i] += part
        spent += part
    return sorted(((r[0] is None, r[0] or 0), n, total[r[2]], target[r[2]], t) for r, n, t in zip(rows, size, taken)), target, total


def found(df):
    return sorted(((r.id is None, r.id or 0), r.size, r.source_size, r.target, r.taken) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_sorted_list(spark, seed):
    import random
    rng = random.Random(seed)
    rows = [(rng.choice([i, None, 7]), " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(["a", "a", "a", "a", "b", "é", "", None])) for i in range(400)]
    rows += [(7, "one two three", "a")] * 150 + [(8, None, "c"), (9, "x\n" * 3000, "d"), (10, "tiny", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    queue = M.fair_queue(docs.withColumns({c: F.lit("z") for c in ("size", "target", "repeat", "before", "src", "id")}))
    want, target, total = plain(rows)
    assert found(queue.taken()) == want
    mix = queue.mix().collect()
    assert sum(r.words for r in mix) == sum(w[1] for w in want)
    assert all(w[4] <= 3 * w[1] for w in want)
    assert all(r.repeat < 3 for r in mix)
    # another layout, the same mix
    assert found(M.fair_queue(docs.repartition(3)).taken()) == want


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = spark.createDataFrame([("0a", 10, 10), ("0b", 20, 20), ("0c", 1000, 5), ("0d", 0, 0), ("0e", 2000, 5)], "src string, source_size long, longest long")
    got = {r.src: r.target for r in M.targets(sizes).collect()}
    assert got["0a"] == 30 and got["0b"] == 60 and got["0d"] == 0
    assert got["0c"] + got["0e"] == pytest.approx(3030 - 90) and got["0c"] / got["0e"] == pytest.approx(3 / 2)


def test_no_words_and_no_rows(spark, docs):
    assert [tuple(r) for r in M.fair_queue(docs([(1, None), (2, "  \n")])).taken().orderBy("id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    empty = M.fair_queue(docs([]))
    assert empty.taken().count() == 0 and empty.mix().count() == 0


def test_no_python_in_the_plans(spark, docs):
    queue = M.fair_queue(docs([(1, "a b c"), (2, "d e")]))
    for df in (queue.taken(), queue.mix()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
