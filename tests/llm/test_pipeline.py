import sys

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from test_ngram_join import brute as near_brute
from test_packing import check as packing_check
from test_quality_rules import plain
from test_suffix_dedup import brute as span_brute
from valuelens.llm import line_crf, quality_rules
from valuelens.llm.common import stage, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [table(spark, SF, "documents")]
    for name, step in P.STAGES:
        out.append(stage(step(spark, out[-1], SF), "test"))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select(*P.COLUMNS).collect()), key=repr)


def test_names_and_columns(steps):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    assert all(df.columns == list(P.COLUMNS) for df in steps[:-1])


def test_classifier_takes_effect(spark, steps):
    model = line_crf.fitted(spark, SF)
    texts = [r[1] for r in rows(steps[0])]
    x, first, length = line_crf.line_features(next(line_crf.chunks(pa.array(texts), 1 << 30)))
    p = model.quality(x, first, length)[1]
    assert rows(steps[1]) == [r for r, s in zip(rows(steps[0]), p) if s >= 0.3] and 0.5 < (p >= 0.3).mean() < 1


def test_rules_take_effect(steps):
    before = rows(steps[1])
    seen = {r.doc_id: r for r in quality_rules.judge(steps[1], ["doc_id"]).collect()}
    names = [f"vote_{k}" for k in quality_rules.rules()]
    votes = np.array([[seen[r[0]][v] for v in names] for r in before])
    _, _, q = quality_rules.fit(votes, np.ones(len(votes)))
    want = [r for r, p in zip(before, q) if p >= 0.5 and plain(r[1])[0] >= 10 and 5 * plain(r[1])[4] <= plain(r[1])[0]]
    assert rows(steps[2]) == want


def test_one_document_of_each_class_stays(steps):
    before = rows(steps[2])
    classes = near_brute(sorted((r[0], r[1]) for r in before))
    assert rows(steps[3]) == [r for r in before if classes[r[0]][0] == r[0]] and len(rows(steps[3])) < len(before)


def test_repeated_strings_go(steps):
    import hashlib
    want = {r[0]: r[-1] for r in span_brute([(r[0] + 1, r[1]) for r in rows(steps[3])], 200)}
    after = rows(steps[4])
    assert len(after) == len(want)
    ends = [r for r in after if hashlib.sha256(r[1].encode()).hexdigest() == want[r[0] + 1]]
    assert len(ends) >= 0.98 * len(after) and all(r[4] == len(r[1]) for r in after)  # the rest lost part of a character


def test_packing(steps):
    packing_check([(r[0], r[1]) for r in rows(steps[4])], steps[5].collect())


def test_cases(spark, docs):
    df = docs([(1, None), (2, ""), (3, "a fine text " * 9), (3, "a fine text " * 9), (None, "a fine text " * 9), (4, "x" * 40000)])
    for _, step in P.STAGES[:-1]:
        out = step(spark, df, SF).collect()
        assert all(len(r) == 5 for r in out)
    kept = P.near_duplicates(spark, df, SF).collect()
    assert sorted((r.doc_id for r in kept)) == [1, 2, 3, 4]
    empty = docs([])
    for _, step in P.STAGES:
        assert step(spark, empty, SF).count() == 0
    assert P.run(spark, SF).count() > 0 and "corpus_pipeline" in sys.modules
