"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines before
and after it, with a score for each pair of neighbouring labels. Forward-backward gives
each line's marginal probability of good; their mean, weighted by line length and
calibrated, is the document's quality. The fit reads a bounded sample of labelled rows;
scoring reads every line of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, map_texts, table
from .quality_rules import SYMBOL, repeated
from .textnum import Chunk, chunks, mix
from .toxicity import logistic, sample_labelled

#: Bounds of the fit: rows of each label, and the longest text in it, in bytes.
FIT_ROWS, FIT_BYTES = {1: 5000, 0: 3000}, 30_000
#: Rounds of relabelling the lines of bad documents, and gradient steps in each.
ROUNDS, STEPS, RATE, PENALTY = 3, 150, 0.15, 1e-3

_UPPER, _LOWER, _DIGIT, _MARK, _STOP = (np.isin(np.arange(256), list(s)) for s in (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b".,;:"))
_ASCII = np.arange(256) < 128


def line_features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (own, previous and next), each text's first line, and line lengths in bytes."""
    lstart, lend, lfirst = c.lines()
    start, end, first = c.words()
    n, nb = len(lstart), (lend - lstart).astype(float)
    wfirst, wlast = np.searchsorted(start, lstart), np.searchsorted(start, lend)
    nw = (wlast - wfirst).astype(float)
    b, w = np.maximum(nb, 1), np.maximum(nw, 1)

    def in_bytes(flags):
        s = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return s[lend] - s[lstart]

    def in_words(flags):
        s = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return s[wlast] - s[wfirst]

    h = c.hashes(start, end)
    line = np.repeat(np.arange(n), wlast - wfirst)
    text = np.repeat(np.arange(c.n), np.diff(first))
    _, again = repeated(mix(h ^ mix(line.astype(np.uint64) + np.uint64(1))))
    _, before = repeated(mix(h ^ mix(text.astype(np.uint64) + np.uint64(1))))
    beside = np.zeros(len(h), bool)
    beside[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    owner = np.repeat(np.arange(c.n), np.diff(lfirst)).astype(np.uint64)
    _, dup = repeated(mix(c.hashes(lstart, lend) ^ mix(owner + np.uint64(1))))
    last = c.data[end - 1] if len(end) else np.zeros(0, np.uint8)
    low = np.concatenate([[0], np.cumsum(_LOWER[c.data] | ~_ASCII[c.data])])
    upper, lower = in_bytes(_UPPER[c.data]), in_bytes(_LOWER[c.data])
    f = np.column_stack([
        np.log1p(nb) / 5, np.log1p(nw) / 4, upper / np.maximum(upper + lower, 1), in_bytes(_DIGIT[c.data]) / b, in_bytes(SYMBOL[c.data]) / b,
        in_bytes(_MARK[c.data]) / b, in_bytes(_STOP[c.data]) / b, in_bytes(~_ASCII[c.data]) / b, np.minimum(nb / w / 20, 2), 1 - in_words(again) / w,
        in_words(beside) / w, in_words(before) / w, dup & (nw > 0), in_words(SYMBOL[last] | _MARK[last]) / w,
        in_words(low[end] == low[start]) / w, nw == 0, np.repeat(np.diff(lfirst) == 1, np.diff(lfirst)),
    ]).astype(np.float64) if n else np.zeros((0, 17))
    prev, nxt = np.zeros_like(f), np.zeros_like(f)
    prev[1:], nxt[:-1] = f[:-1], f[1:]
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[lfirst[:-1]] = True
    is_last[lfirst[1:] - 1] = True
    prev[is_first] = 0
    nxt[is_last] = 0
    return np.column_stack([f, prev, nxt, is_first, is_last, np.ones(n)]), lfirst, nb


def marginals(emission: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected label pairs (2 x 2) summed over all neighbours.

    ``emission`` is the score of good over bad; chain i holds lines first[i]..first[i+1].
    Position t of all chains is done at once, longest chains first.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    most = int(length.max()) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(most)]  # chains longer than t
    fwd, bwd = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))

    def step(score, at):  # log of the sums over the other label
        return np.logaddexp(score[:, :1] + at[0], score[:, 1:] + at[1])

    for t in range(most):
        k = active[t]
        now = start[:k] + t
        if t:
            fwd[now] = step(fwd[now - 1], trans)
        fwd[now, 1] += emission[now]
    for t in range(most - 2, -1, -1):
        k = active[t + 1]
        now = start[:k] + t
        after = bwd[now + 1].copy()
        after[:, 1] += emission[now + 1]
        bwd[now] = step(after, trans.T)
    both = fwd + bwd
    p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.ones(len(emission), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    now = np.flatnonzero(inner)
    if not len(now):
        return p, np.zeros((2, 2))
    z = np.logaddexp(both[now, 0], both[now, 1])
    right = bwd[now].copy()
    right[:, 1] += emission[now]
    pair = np.exp(fwd[now - 1][:, :, None] + trans[None] + right[:, None, :] - z[:, None, None])
    return p, pair.sum(0)


@dataclass
class Model:
    """Line weights, label-pair scores, and slope and constant of the calibration."""

    weight: np.ndarray
    trans: np.ndarray
    calibration: np.ndarray

    def quality(self, x: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean marginal and calibrated score of each text."""
        p, _ = marginals(x @ self.weight, self.trans, first)
        total = lambda v: np.concatenate([[0.0], np.cumsum(v)])[first]
        mean = np.diff(total(p * (length + 1))) / np.diff(total(length + 1))
        return mean, 1 / (1 + np.exp(-np.clip(logit(mean) * self.calibration[0] + self.calibration[1], -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(x: np.ndarray, first: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line weights and label-pair scores by gradient ascent on the chains' conditional likelihood.

    ``good`` labels texts. Lines take their text's label at first; after each round the
    lines of a bad text that the model calls good count as good, all but its worst one.
    """
    owner = np.repeat(np.arange(len(good)), np.diff(first))
    y = good[owner].astype(float)
    weight, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    n = max(len(x), 1)
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    now = np.flatnonzero(inner)
    for turn in range(ROUNDS):
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (y[now - 1].astype(int), y[now].astype(int)), 1)
        m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
        for k in range(1, STEPS + 1):
            p, expected = marginals(x @ weight, trans, first)
            g = np.concatenate([x.T @ (y - p) / n - PENALTY * weight, ((pairs - expected) / n - PENALTY * trans).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            d = RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            weight, trans = weight + d[:-4], trans + d[-4:].reshape(2, 2)
        if turn + 1 < ROUNDS:
            p, _ = marginals(x @ weight, trans, first)
            worst = np.full(len(good), np.inf)
            np.minimum.at(worst, owner, p)
            y = np.where(good[owner], 1.0, ((p >= 0.5) & (p > worst[owner])).astype(float))
    return weight, trans


def fit(sample: list[tuple[bytes, int]], share: float) -> Model:
    """Train on (text, label) pairs; ``share`` is the share of label 1 among all labelled rows.

    The field learns from three of four texts, the calibration from the fourth. With no
    text of a label every score is ``share``.
    """
    y = np.array([label for _, label in sample], float)
    if not len(y) or y.min() == y.max():
        share = min(max(share, 1e-4), 1 - 1e-4)
        return Model(np.zeros(17 * 3 + 3), np.zeros((2, 2)), np.array([0.0, np.log(share / (1 - share))]))
    held = np.arange(len(y)) % 4 == 3

    parts = []
    for rows in (~held, held):
        got = [line_features(c) for c in chunks(pa.array([t for (t, _), r in zip(sample, rows, strict=True) if r], pa.binary()))]
        base = np.concatenate([[0], np.cumsum([g[1][-1] for g in got])])
        parts.append((np.concatenate([g[0].astype(np.float32) for g in got]),
                      np.concatenate([g[1][:-1] + o for g, o in zip(got, base, strict=False)] + [base[-1:]]), np.concatenate([g[2] for g in got])))
        del got
    (x, first, _), rest = parts
    model = Model(*train(x, first, y[~held] == 1), np.array([1.0, 0.0]))
    z = y[held]
    if len(z) and z.min() < z.max():
        n = len(z)
        model.calibration = logistic(logit(model.quality(*rest)[0])[:, None], z, np.where(z == 1, share * n / z.sum(), (1 - share) * n / (n - z.sum())), 0.1)
    return model


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, score (0 to 1), good_share (before calibration) and n_lines of every row.

    A null or empty text is one empty line; repeated rows score alike; an empty table
    gives an empty result; other columns are not read.
    """
    def one(c: Chunk):
        x, first, length = line_features(c)
        mean, p = model.quality(x, first, length)
        return [p, mean, np.diff(first)]

    return map_texts(df, text, keep, "score double, good_share double, n_lines long", one)


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the labelled rows outside fold 0 of 5."""
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 5) != 0)
    return fit(*sample_labelled(table(spark, sf_dir, "documents"), labels, "quality", FIT_ROWS, FIT_BYTES))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labelled rows of folds 1 to 4 of 5."""
    out = score(table(spark, sf_dir, "documents"), fitted(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op10_line_crf": op10_line_crf}
