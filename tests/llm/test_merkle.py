import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from valuelens.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    out = []
    for x in row:
        s = None if x is None else str(x)
        out.append("-" if s is None else f"{len(s.encode())}:{s}")
    return H(*out)


def tree(nodes):
    """Root, and each leaf's siblings as (before, after) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a - a % 3:a - a % 3 + 3]
            paths[i].append(("".join(run[:a % 3]), "".join(run[a % 3 + 1:])))
        nodes = [H(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
        at = [a // 3 for a in at]
    return nodes[0], paths


def plain(rows):
    """Rows are doc_id, source, lang, n_chars, text."""
    groups = {}
    if not rows:
        return []
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, below = [], {}
    for s in names:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = tree([leaf(r) for r in mine])
        tops.append(top)
        below[s] = (mine, paths)
    root, over = tree(tops)
    out = []
    for s, top, up in zip(names, tops, over):
        for r, path in zip(*below[s]):
            path = path + up
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                changed = (*r[:4], r[4].replace("\n", ""))
            node = leaf(changed)
            for before, after in path:
                node = H(before, node, after)
            out.append((r[0], leaf(r), top, root, H(*[b + a for b, a in path]), node, node == root))
    return out


def check(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumns({c: F.lit("z") for c in ("leaf", "grp", "i", "n", "path")}).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in M.op12_lag_lead(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    return got


@pytest.mark.parametrize("sizes", [[1], [3], [4], [1, 1], [243, 244, 242, 1, 2, 3], [730, 9, 10, 27, 28]])
def test_equals_a_plain_tree(spark, tmp_path, sizes):
    rows = [(17 * i, f"s{k}", "en", i, f"line {i}\n{k}") for k, n in enumerate(sizes) for i in range(n)]
    got = check(spark, rows, tmp_path)
    assert len(got) < 10 or {r[-1] for r in got} == {True, False}


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, None, "é", 3, "a\nb"), (1, "", "", 0, ""), (2, "x", "en", 4, "\n" * 200_000)]
    rows += [(5, "x", "en", 1, "same\n")] * 300 + [(5, "x", "en", 2, "other"), (None, "x", None, None, "\n"), (6, "é", "en", 1, "ab"), (6, "z", "en", 1, "1:-")]
    check(spark, rows, tmp_path)


def test_many_sources(spark, tmp_path):
    check(spark, [(i, f"s{i:04}", "en", 1, "t\n") for i in range(300)], tmp_path)


def test_empty_table(spark, tmp_path):
    check(spark, [], tmp_path)
