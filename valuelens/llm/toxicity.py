"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text, over the
same base dictionary. A window of a text that shares strings with toxic text compresses
further with the toxic dictionary; the differences of all windows of a text, counted at
several thresholds, give its calibrated probability. The fit reads a bounded sample of
labelled rows; scoring reads every window of every text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, map_texts, table
from .textnum import Chunk, chunks, shingles

#: Bounds of the fit: rows of each label, and the longest text in it, in bytes.
FIT_ROWS, FIT_BYTES = {1: 3000, 0: 9000}, 20_000
WINDOW, LEVEL, DICT_BYTES, BASE_BYTES = 96, 13, 3072, 4096
#: Words that tell a class: at most TYPICAL, with a likelihood-ratio statistic of G2 or more.
TYPICAL, G2, LEAST_TYPICAL = 256, 25.0, 16
#: Margins (bytes) at which a text's windows are counted.
STEPS = (2, 3, 4, 6, 8)


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """All of a text, cut after the first space at or past each ``size`` bytes (at 4 * size without one)."""
    out, at = [], 0
    while at < len(text):
        end = text.find(b" ", at + size, at + 4 * size)
        end = min(at + 4 * size, len(text)) if end < 0 else end
        out.append(text[at:end])
        at = end
    return out


def folded(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode()


def _words(text: bytes) -> list[bytes]:
    return text.translate(bytes(32 if b in b".,;:!?\t\r\n" else b for b in range(256))).split()


def typical(own: list[bytes], other: list[bytes]) -> set[bytes]:
    """Words found in at least twice the share of ``own`` texts than of ``other`` ones, by likelihood ratio."""
    count = [Counter(), Counter()]
    for c, texts in zip(count, (own, other), strict=True):
        for t in texts:
            c.update(set(_words(t)))
    words = [w for w, n in count[0].items() if n >= 3 and n * max(len(other), 1) > 2 * count[1][w] * len(own)]
    if not words or not other:
        return set(words[:TYPICAL])
    a, b = (np.array([c[w] for w in words], float) for c in count)
    n, m = len(own), len(other)
    p = (a + b) / (n + m)
    part = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(e, 1e-12)), 0)
    g = 2 * (part(a, n * p) + part(b, m * p) + part(n - a, n * (1 - p)) + part(m - b, m * (1 - p)))
    order = sorted(range(len(words)), key=lambda i: (-g[i], words[i]))
    return {words[i] for k, i in enumerate(order[:TYPICAL]) if g[i] >= G2 or k < LEAST_TYPICAL}


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary's content of ``size`` bytes or less; the samples themselves where there are too few to train on."""
    samples = [s for s in samples if len(s) >= 8]
    while size >= 256 and samples:
        try:
            return zstd.train_dictionary(size, samples).as_bytes()[-size:]
        except zstd.ZstdError:
            size //= 2
    return b"".join(samples)[:1024]


def distinct_texts(texts: list[bytes]) -> list[int]:
    """Texts left when one that shares a low shingle with an earlier one goes: copies would pose as typical."""
    seen: set[int] = set()
    out = []
    for i, t in enumerate(texts):
        for c in chunks(pa.array([t], pa.binary()), 1 << 30):
            start, end, first = c.words()
            h, _ = shingles(c.hashes(start, end), first)
            low = set(np.sort(h)[:4].tolist())
            if low and not low & seen:
                out.append(i)
            seen |= low
    return out


@dataclass
class Model:
    """Both dictionaries' contents, the features' centres and scales, and the calibration's weights."""

    toxic: bytes
    ordinary: bytes
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def compressors(self) -> list[zstd.ZstdCompressor]:
        plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        return [zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), **plain)
                for d in (self.ordinary or b" " * 8, self.toxic or b" " * 8)]


def margins(pieces: list[bytes], compressors: list[zstd.ZstdCompressor]) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary one on each window."""
    if not pieces:
        return np.zeros(0, np.int64)
    sizes = []
    for c in compressors:
        done = c.multi_compress_to_buffer(pieces, threads=1)
        sizes.append(np.fromiter((len(done[i]) for i in range(len(pieces))), np.int64, len(pieces)))
    return sizes[0] - sizes[1]


def features(texts: list[bytes], compressors: list[zstd.ZstdCompressor]) -> tuple[np.ndarray, np.ndarray]:
    """One row per text from the margins of all its windows (zeros for an empty text), and its number of windows."""
    cut = [windows(folded(t)) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(int)
    gain = margins([w for x in cut for w in x], compressors)
    out = np.zeros((len(texts), 4 + 2 * len(STEPS)))
    for i in range(len(texts)):
        g = gain[first[i]:first[i + 1]]
        if len(g):
            top = np.partition(g, len(g) - min(3, len(g)))[-3:]
            over = np.array([(g >= s).sum() for s in STEPS])
            out[i] = [g.max(), top.mean(), g.mean(), np.log(len(g)), *np.log1p(over), *(over / len(g))]
    return out, np.diff(first)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights of a penalised logistic regression (last: the constant, free of penalty), by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionaries(part: dict[int, list[bytes]]) -> Model:
    """A model without calibration, its dictionaries trained on the folded texts of each label."""
    learn = {y: [part[y][i] for i in distinct_texts(part[y])] for y in part}
    base = train_dictionary([w for t in learn[0] for w in windows(t, 64)], BASE_BYTES)
    content = {}
    for y in (0, 1):
        told = typical(learn[y], learn[1 - y])
        runs = [[w for w in _words(t) if w in told] for t in learn[y]]
        content[y] = base + train_dictionary([b" " + b" ".join(r[i:i + 4]) + b" " for r in runs for i in range(0, len(r), 4)], DICT_BYTES)
    return Model(content[1], content[0], np.zeros(0), np.zeros(0), np.zeros(0))


def fit(sample: list[tuple[bytes, int]], share: float) -> Model:
    """Train on (text, label) pairs; ``share`` is the share of label 1 among all labelled rows.

    The calibration sees each text through dictionaries of the other half of the sample;
    the model's own dictionaries come from all of it. With no text of a label, every
    score is ``share``.
    """
    part = {y: [folded(t) for t, label in sample if label == y] for y in (0, 1)}
    x, y = [], []
    for h in (0, 1):
        other = dictionaries({k: part[k][1 - h::2] for k in part}).compressors()
        for k in part:
            x.append(features(part[k][h::2], other)[0])
            y += [float(k)] * len(x[-1])
    x, y, n = np.concatenate(x), np.array(y), len(y)
    model = dictionaries(part)
    if not n or y.min() == y.max():
        model.centre, model.scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
        share = min(max(share, 1e-4), 1 - 1e-4)
        model.weight = np.append(np.zeros(x.shape[1]), np.log(share / (1 - share)))
        return model
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weight = logistic((x - model.centre) / model.scale, y, np.where(y == 1, share * n / y.sum(), (1 - share) * n / (n - y.sum())))
    return model


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int] = FIT_ROWS, longest: int = FIT_BYTES,
                    key: str = "doc_id", text: str = "text") -> tuple[list[tuple[bytes, int]], float]:
    """A bounded sample of (text, label) and the share of label 1 among all rows of ``labels``.

    Per label the ``rows`` keys that hash lowest are drawn from the labels and sent to the
    scan of the texts, so no text is shuffled; those of more than ``longest`` bytes are
    left out. This much reaches the driver whatever the input's size.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    total = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    known = known.withColumn("_h", F.xxhash64(key, F.lit(label)))
    texts = docs.select(key, text).where(F.col(text).isNotNull() & (F.octet_length(text) <= longest))
    out = []
    for y in (0, 1):
        drawn = known.where(F.col("_label") == y).orderBy("_h", key).limit(rows[y])
        got = texts.join(F.broadcast(drawn), key).orderBy("_h", text).limit(rows[y]).select(text).collect()
        out += [(r[0].encode(), y) for r in got]
    return out, total.get(1, 0) / max(sum(total.values()), 1)


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, score (0 to 1) and n_windows of every row.

    A null or empty text has no window and one fixed score; repeated rows score alike; an
    empty table gives an empty result; other columns are not read.
    """
    def one(c: Chunk):
        if "made" not in state:
            state["made"] = model.compressors()
        x, n = features([c.text(i) for i in range(c.n)], state["made"])
        z = np.column_stack([(x - model.centre) / model.scale, np.ones(len(x))]) @ model.weight
        return [1 / (1 + np.exp(-np.clip(z, -30, 30))), n]

    state: dict = {}
    return map_texts(df, text, keep, "score double, n_windows long", one)


def op4_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled rows of folds 0, 1 and 3 of 4."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample, share = sample_labelled(docs, labels.where(crc_fold("doc_id", 4) != 2), "toxic")
    out = score(docs, fit(sample, share), ["doc_id"])
    return out.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op4_compression_distance": op4_compression_distance}
