import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from valuelens.llm import packing as P
from valuelens.llm.common import table


def test_differencing_places_every_item():
    rng = np.random.default_rng(0)
    for k in (1, 2, 7, 40):
        size = rng.integers(1, 500, 200)
        window, load = P.differencing(size, k)
        assert (np.bincount(window, size, k) == load).all()
        assert k > 20 or load.max() - load.min() <= 25
    assert P.differencing(np.array([8, 7, 6, 5, 4]), 2)[1].tolist() in ([16, 14], [15, 15])


def test_window_count_rises():
    assert P.pack(np.array([1500] * 5)).max() == 4
    assert len(P.pack(np.zeros(0, int))) == 0


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encode(t):
    return TOKENIZER.encode(t or "", add_special_tokens=False).ids + [1]


def check(rows, out):
    by, seq = defaultdict(list), defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for key, text in rows:
        ids, at = encode(text), 0
        for r in sorted(by[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return 1 - sum(r.length for r in out) / (2048 * len(seq))


ROWS = [(1, "Hello, world! don't stop.The end..."), (2, None), (3, ""), (4, "<|endoftext|> a<|startoftext|>b x|y"), (5, "word " * 9000),
        (6, "É́a b c é, ñandú 12ab34 中文字"), (7, "x" * 20000), (8, "I'LL 'ss o'r a.'t b,'s \x00\x1c\x85z"), (9, "á. b;́c *́ %z%")]


def test_pieces_are_the_tokenizers(spark, docs):
    df = docs(ROWS).withColumnsRenamed({"lang": "length", "source": "start"})
    out = P.pack_documents(df, with_ids=True).collect()
    check(ROWS, out)
    assert all(r.ids == encode(dict(ROWS)[r.doc_id])[r.start:r.start + r.length] for r in out)


def test_repeated_rows_and_empty_table(spark, docs):
    out = P.pack_documents(docs([(1, "a b c")] * 700 + [(None, "q")])).collect()
    assert len(out) == 701 and sum(r.length for r in out) == 700 * 4 + 2
    assert P.pack_documents(docs([])).count() == 0


def test_whole_table_with_little_padding(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert check(rows, P.op9_karmarkar_karp(spark, sf).collect()) < 0.02


def test_many_words_in_a_full_memory(monkeypatch):
    from valuelens.llm.textnum import chunks
    import pyarrow as pa
    monkeypatch.setattr(P, "REMEMBERED", 50)
    monkeypatch.setattr(P, "SLOTS", 128)
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abé,A"), rng.integers(1, 5))) for _ in range(60)) for _ in range(30)]
    words, got = P.WordIds(public_tokenizers.path("word_bpe_49k.json")), []
    for c in chunks(pa.array(texts), 500):
        ids, first = words(c)
        got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert got == [encode(t) for t in texts]
