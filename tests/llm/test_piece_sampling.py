import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from valuelens.llm import piece_sampling as S
from valuelens.llm.textnum import chunks


def coded(texts, seeds=None, limit=1 << 20):
    v, out = S.vocabulary(None, 1.0), []
    for c in chunks(pa.array(texts, pa.string()), limit):
        s = np.arange(c.first, c.first + c.n, dtype=np.uint64) if seeds is None else np.array(seeds[c.first:c.first + c.n], np.uint64)
        ids, first = S.sample_ids(c, s, v)
        out += [ids[a:b].tolist() for a, b in itertools.pairwise(first)]
    return out


def spelled(ids):
    v = S.vocabulary(None, 1.0)
    return b"".join(v.surface[i] for i in ids)[1:].decode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8), st.integers(1, 60))
def test_round_trip_and_batches(texts, limit):
    texts += ["a  b", "▁x ▁", " lead", "tail ", "\n\n", "中文 éè́", "\x00"]
    got = coded(texts)
    assert [spelled(x) for x in got] == texts
    assert coded(texts, limit=limit) == got


def test_frequencies_follow_the_lattice():
    """Share of each segmentation of a short word against its weight in a full enumeration."""
    v, word, n = S.vocabulary(None, 1.0), b" then", 40000
    weight = {}
    c = next(chunks(pa.array([word], pa.binary())))
    for cut in itertools.product((0, 1), repeat=len(word) - 1):
        at = [0, *[i + 1 for i, x in enumerate(cut) if x], len(word)]
        slots = [int(v.find(c.hashes(np.array([a]), np.array([b])))[0]) for a, b in itertools.pairwise(at)]
        if all(s >= 0 and v.id[s] >= 0 for s in slots):
            weight[tuple(int(v.id[s]) for s in slots)] = float(np.exp(sum(v.weight[s] for s in slots)))
    got = Counter(map(tuple, coded(["then"] * n)))
    total = sum(weight.values())
    assert set(got) <= set(weight) and len(got) > 3
    for k, w in weight.items():
        p = w / total
        assert abs(got[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_the_library_decodes_the_ids():
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(S.MODEL))
    texts = ["Hello there, world.", "ñandú the 42 中", "new\nline"]
    assert [m.decode(x) for x in coded(texts)] == texts


def test_rows(spark, docs):
    rows = [(1, "The same text here."), (1, "The same text here."), (2, "The same text here."), (3, None), (4, ""), (None, "x" * 20000), (5, "a " * 9000)]
    df = docs(rows).withColumnsRenamed({"lang": "_seed", "source": "ids"})
    out = S.encode(df.repartition(3), ["doc_id"]).collect()
    by = {r.doc_id: r for r in out}
    one = [r.ids for r in out if r.doc_id == 1]
    assert len(out) == len(rows) and one[0] == one[1] and by[3].ids is None and by[3].ids_crc32 is None and by[4].ids == []
    back = {r.doc_id: r.text for r in S.decode(S.encode(df, ["doc_id"]), ["doc_id"]).collect()}
    assert back == dict(rows)
    assert S.encode(docs([]), ["doc_id"]).count() == 0


def test_whole_table_is_lossless(spark):
    out = S.op5_sampled_pieces(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == 1000 and all(r.lossless for r in out)


def test_round_trip_is_encode_and_decode(spark, docs):
    rows = [(1, "one two  three\n"), (2, None), (3, ""), (None, "é \x00 x"), (3, "again " * 300_000), (3, "again " * 300_000), (4, " lead and trail ")]
    df = docs(rows).withColumnRenamed("lang", "n_pieces")
    out = S.round_trip(df, ["doc_id", "n_pieces"])
    assert out.columns == ["doc_id", "n_pieces", "_n_pieces", "ids_crc32", "lossless"]
    one = sorted((r.doc_id or 0, r._n_pieces or 0, r.ids_crc32 or 0, r.lossless) for r in out.collect())
    two = sorted((r.doc_id or 0, len(r.ids or []), r.ids_crc32 or 0, True) for r in S.encode(df, ["doc_id"]).collect())
    assert one == two
    assert S.encode(df.withColumnRenamed("source", "ids"), ["doc_id", "ids"]).columns == ["doc_id", "ids", "_ids", "ids_crc32"]
    assert S.round_trip(docs([]), ["doc_id"]).count() == 0


def test_spelled_texts_of_a_chunk():
    v = S.vocabulary(None, 1.0)
    c = next(chunks(pa.array(["abc def", "", "x"])))
    data, off = S.spelled(*S.sample_ids(c, np.zeros(3, np.uint64), v), v)
    assert data.tobytes() == b"abc defx" and off.tolist() == [0, 7, 7, 8]
