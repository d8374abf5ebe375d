"""Source divergence audit: how a source's words differ from its language and from other sources.

A term's share in a group is p = 1 + floor(SCALE * (count + 1) / (N + V)), and the
divergence of p from q is floor((p - q) ** 2 / q); all arithmetic is in whole numbers.

* Top terms of a group: the divergence from the language rises with the group's count and
  falls with the language's, and ties go to the earlier term. So a term that ``top`` others
  dominate (group count as high, language count as low, earlier in UTF-8) can't be among
  the ``top``. Partitions keep their skyband, the terms that fewer dominate; skybands are
  merged in fewer partitions, and what stays is ranked exactly.
* Pairs of sources: sources are cut into blocks, terms into shards; a unit of a shard and
  two blocks has the blocks' shares as two dense matrices and sums the divergences. Terms
  that neither block has add one constant for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table
from .graph import in_units, whole_units
from .textnum import chunks

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: Bytes of text counted at once; rows of a partition of the skyband; sources in a block; rows in a shard; terms of a unit at once.
CHUNK, PART, SOURCES, SHARD, SLICE = 2 << 20, 4096, 64, 50_000, 512

# Bytes of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``, and A-Z lower-cased.
LETTER = np.ones(256, bool)
LETTER[0x00:0x41] = LETTER[0x5B:0x61] = LETTER[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of texts (``data`` cut at ``off``), and the number of the term and of the text of every occurrence."""
    inside = LETTER[data]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    new[edge] = inside[edge]
    start = np.flatnonzero(new)
    body = LOWER[data[inside]]
    place = np.cumsum(inside, dtype=np.int32)[start] - 1 if len(start) else start
    cut = np.append(place, len(body)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cut), pa.py_buffer(body)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), np.searchsorted(off, start, "right") - 1


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and texts, added up within runs of texts."""
    def run(batches):
        for batch in batches:
            code = [batch.column(k).dictionary_encode() for k in (0, 1)]
            wide = max(len(code[1].dictionary), 1)
            group = code[0].indices.to_numpy().astype(np.int64) * wide + code[1].indices.to_numpy()
            for c in chunks(batch.column(2), CHUNK):
                words, word, text = terms(c.data, c.off)
                if not len(word):
                    continue
                seen, n = np.unique(text * len(words) + word, return_counts=True)
                key = group[c.first + seen // len(words)] * len(words) + seen % len(words)
                order = np.argsort(key, kind="stable")
                key, n = key[order], n[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                g, w = key[first] // len(words), key[first] % len(words)
                yield pa.RecordBatch.from_arrays(
                    [code[0].dictionary.take(pa.array(g // wide)).cast(pa.string()), code[1].dictionary.take(pa.array(g % wide)).cast(pa.string()),
                     words.take(pa.array(w)).cast(pa.large_string()).cast(pa.string()), pa.array(np.add.reduceat(n, first)), pa.array(np.diff(np.append(first, len(key))))],
                    names=["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: str, words: str, vocabulary: str) -> Column:
    """p of a count, exactly; 1 where there are no terms."""
    return F.expr(f"1 + coalesce((cast({SCALE} AS decimal(20,0)) * ({count} + 1)) div nullif({words} + {vocabulary}, 0), 0)").cast("long")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}").cast("long")


def in_skyband(high: np.ndarray, low: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Which points fewer than ``k`` others dominate: higher or equal ``high``, lower or equal ``low``, lower ``name``.

    Who dominates a point comes before it in the order (high falling, low, name), and a
    point with k dominators has k among those that are kept; runs are compared with these.
    """
    order = np.lexsort((name, low, -high))
    lo, nm = low[order], name[order]
    kept_lo, kept_nm, keep = lo[:0], nm[:0], np.zeros(len(order), bool)
    for a in range(0, len(order), 1024):
        x, y = lo[a:a + 1024], nm[a:a + 1024]
        n = ((kept_lo <= x[:, None]) & (kept_nm < y[:, None])).sum(1)
        n += np.tril((x[None] <= x[:, None]) & (y[None] < y[:, None]), -1).sum(1)
        ok = n < k
        keep[a:a + 1024] = ok
        kept_lo, kept_nm = np.append(kept_lo, x[ok]), np.append(kept_nm, y[ok])
    out = np.zeros(len(order), bool)
    out[order] = keep
    return out


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """Rows (lang, source, term, n, lang_n) that fewer than ``k`` of their partition dominate.

    A partition is a group's terms of one hash; it has about PART rows, so no group meets
    in one task. Skybands are merged in fewer partitions once, and again as long as a
    merge halves the rows; the exact ranks need no more.
    """
    def run(batches):
        for t, first in whole_units(batches, 3):
            n, lang_n = t.column(4).to_numpy(), t.column(5).to_numpy()
            ok = np.zeros(t.num_rows, bool)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):  # rows of a unit lie in UTF-8 order
                ok[a:b] = in_skyband(n[a:b], lang_n[a:b], np.arange(b - a), k)
            yield from t.filter(pa.array(ok)).select(["lang", "source", "term", "n", "lang_n"]).to_batches()

    parts, before, rounds = None, None, 0
    while True:
        largest, total = rows.groupBy("lang", "source").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
        now = max(1, -(-largest // PART))
        if parts is not None and (now >= parts or rounds > 1 and 2 * total > before):
            return rows
        before, rounds = total, rounds + 1
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(now)))
        rows = stage(in_units(dealt, ["lang", "source", "part"], ["term"]).select("lang", "source", "part", "term", "n", "lang_n")
                     .mapInArrow(run, "lang string, source string, term string, n long, lang_n long"), "skyband")
        parts = now
        if parts == 1:
            return rows


def pair_sums(rows: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """lang, a, b, value, touched: divergence of source number a from b over the terms that a unit's blocks have, and how many these are.

    ``rows`` has lang, term, no, p; ``groups`` has lang, no, sources, p (that of a term without occurrence).
    """
    blocks = F.ceil(F.col("sources") / SOURCES).cast("int")
    dealt = rows.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "term", "no", "p", "sources")
    none = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("string").alias("term"), "no", "p", "sources")
    own = F.floor(F.col("no") / SOURCES).cast("int")
    units = (dealt.unionByName(none).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("lang", "shard", F.least(own, "other").alias("lo"), F.greatest(own, "other").alias("hi"), "term", "no", "p"))

    def run(batches):
        for t, first in whole_units(batches, 4):
            lo, hi, no, p = (t.column(k).to_numpy() for k in (2, 3, 5, 6))
            absent = t.column(4).is_null().to_numpy()
            code = t.column(4).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                n, q, gone, word = no[a:b], p[a:b], absent[a:b], code[a:b]
                sides = []
                for block in (lo[a], hi[a]):
                    mine = n // SOURCES == block
                    base = np.zeros(int(n[mine].max()) - int(block) * SOURCES + 1, np.int64)
                    base[n[mine & gone] - block * SOURCES] = q[mine & gone]
                    sides.append((int(block) * SOURCES, base, mine & ~gone))
                _, word = np.unique(word[~gone], return_inverse=True)
                at = np.zeros(b - a, np.int64)
                at[~gone] = word
                total = int(word.max()) + 1 if len(word) else 0
                sums = [np.zeros((len(sides[0][1]), len(sides[1][1])), np.int64) for _ in range(2)]
                for s in range(0, total, SLICE):
                    size = min(SLICE, total - s)
                    m = []
                    for zero, base, mine in sides:
                        x = np.repeat(base[None], size, 0)
                        here = mine & (at >= s) & (at < s + size)
                        x[at[here] - s, n[here] - zero] = q[here]
                        m.append(x)
                    d = (m[0][:, :, None] - m[1][:, None, :]) ** 2
                    sums[0] += (d // m[1][:, None, :]).sum(0)
                    sums[1] += (d // m[0][:, :, None]).sum(0)
                i, j = (x.ravel() for x in np.indices(sums[0].shape))
                one, two, value = [sides[0][0] + i], [sides[1][0] + j], [sums[0].ravel()]
                if lo[a] != hi[a]:
                    one, two, value = one + [sides[1][0] + j], two + [sides[0][0] + i], value + [sums[1].ravel()]
                one, two, value = map(np.concatenate, (one, two, value))
                ok = one != two
                yield pa.RecordBatch.from_arrays([pa.array([t.column(0)[a].as_py()] * int(ok.sum()), pa.string()), pa.array(one[ok]), pa.array(two[ok]), pa.array(value[ok]), pa.array(np.full(int(ok.sum()), total))],
                                                 names=["lang", "a", "b", "value", "touched"])

    parts = in_units(units, ["lang", "shard", "lo", "hi"], ["term", "no"]).select("lang", "shard", "lo", "hi", "term", "no", "p").mapInArrow(run, "lang string, a long, b long, value long, touched long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("touched").alias("touched"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every group's ``top`` terms, and its divergence from every other source of its language.

    A null lang, source or text is read as the empty one. Every row is a document of its
    own, rows that repeat others too. A group without terms has pairs, with value 0 if its
    language has no terms. An empty table gives an empty result; other columns are not read.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = counted(read).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = found.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("all_docs"),
                        F.row_number().over(term.orderBy("source")).alias("nth")).where(F.col("all_docs") >= least_docs)
    kept = stage(kept.select("lang", "source", "term", "n", "lang_n", (F.col("nth") == 1).alias("once")), "terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count_if("once").alias("own"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("lang")
    groups = read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["words", "own", "rows"])
    groups = stage(groups.select("lang", "source", "words", "rows", F.sum("words").over(whole).alias("lang_words"), F.sum("own").over(whole).alias("vocabulary"),
                                 F.count(F.lit(1)).over(whole).alias("sources"), (F.row_number().over(whole.orderBy("source")) - 1).cast("long").alias("no")), "groups")
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    best = skyband(kept.drop("once"), top).join(groups, ["lang", "source"])
    best = best.withColumn("p", share("n", "words", "vocabulary")).withColumn("q", share("lang_n", "lang_words", "vocabulary")).where("p > q")
    best = best.select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
    best = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)

    shards = max(1, -(-(groups.agg(F.sum("rows")).first()[0] or 0) // SHARD))
    zero = groups.withColumn("p", share("0", "words", "vocabulary"))
    rows = kept.join(groups, ["lang", "source"]).select("lang", "term", "no", share("n", "words", "vocabulary").alias("p"), "sources")
    both = pair_sums(rows, zero.select("lang", "no", "p", "sources"), shards)
    one = zero.select("lang", F.col("no").alias("a"), "source", F.col("p").alias("p0"), "vocabulary")
    two = zero.select("lang", F.col("no").alias("b"), F.col("source").alias("item"), F.col("p").alias("q0"))
    pairs = both.join(one, ["lang", "a"]).join(two, ["lang", "b"])
    pairs = pairs.select("lang", "source", "item", (F.col("value") + divergence("p0", "q0") * (F.col("vocabulary") - F.col("touched"))).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(place))

    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return best.select(*columns("term")).unionByName(pairs.select(*columns("pair")))


def op13_skyband(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 200 terms and all pairs of every (lang, source) group of ``documents``."""
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES = {"op13_skyband": op13_skyband}
SQL = {"op13_skyband": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN l USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT lang, source, coalesce(any_value(x.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) x USING (lang, source) GROUP BY lang, source),
v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS n FROM l GROUP BY lang),
p AS (
  SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p,
    1 + ({SCALE}::HUGEINT * (l.lang_n + 1)) // (v.n + v.v) AS q
  FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
r AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q
  UNION ALL
  SELECT g.lang, g.source, 'pair', h.source, coalesce(x.value, 0) FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS o, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
             GROUP BY ALL) x ON x.lang = g.lang AND x.s = g.source AND x.o = h.source)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}
"""}
