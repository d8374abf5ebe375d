"""Quality rules by weak supervision.

Each rule votes good (1) or bad (-1) on a document or abstains (0). A label model holds a
prior and how often each rule votes so on good and on bad documents;
expectation-maximisation fits them to the counts of vote patterns of the whole corpus,
of which there are at most 3 ** rules, so only these reach the driver. A document is kept if its pattern's
posterior probability of good is at least one half.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table
from .textnum import SPACE, Chunk, mix, shingles, sums

# The symbols that the base counts.
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True

COUNTS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, "
          "n_lower long, n_marks long, n_distinct long, n_odd_words long, n_odd_lines long")
WINDOW = 5
#: Pseudo-documents of each class: bad and good votes of a rule on good ones (the other way round on bad ones), and their number.
PSEUDO, PSEUDO_TOTAL = np.array([1.0, 4.0]), 10.0


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; is it a later occurrence."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def _within(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(h ^ mix(np.repeat(np.arange(1, len(first), dtype=np.uint64), np.diff(first))))


def text_counts(c: Chunk) -> list[np.ndarray]:
    """The columns of COUNTS for each text of a chunk."""
    start, end, first = c.words()
    words = np.diff(first)
    codes = np.concatenate([[0], np.cumsum(((c.data & 0xC0) != 0x80) & ~SPACE[c.data])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[c.data])])
    per = lambda flags: sums(flags, c.off)
    h = c.hashes(start, end)
    _, seen = repeated(_within(h, first))
    # windows of WINDOW words; shorter texts have none
    window, wfirst = shingles(h, first, WINDOW)
    at = np.repeat(first[:-1] - wfirst[:-1], np.diff(wfirst)) + np.arange(wfirst[-1])
    twice, _ = repeated(_within(window, wfirst))
    at = at[twice & (np.repeat(words, np.diff(wfirst)) >= WINDOW)]
    cover = np.cumsum(np.bincount(at, minlength=len(h) + 1)[:len(h) + 1] - np.bincount(at + WINDOW, minlength=len(h) + 1)[:len(h) + 1]) > 0
    lstart, lend, lfirst = c.lines()
    full = np.searchsorted(start, lend) > np.searchsorted(start, lstart)
    text_of = np.repeat(np.arange(c.n), np.diff(lfirst))[full]
    lines = np.bincount(text_of, minlength=c.n)
    lfull = np.concatenate([[0], np.cumsum(lines)])
    _, dup = repeated(_within(c.hashes(lstart[full], lend[full]), lfull))
    upper, lower = (c.data >= 65) & (c.data <= 90), (c.data >= 97) & (c.data <= 122)
    return [words, codes[c.off[1:]] - codes[c.off[:-1]], per(SYMBOL[c.data]), sums(dup, lfull), sums(cover[:len(h)], first),
            lines, per(upper), per(lower), per(_MARK[c.data]), words - sums(seen, first),
            sums(symbols[end] > symbols[start], first), np.bincount(text_of[(symbols[lend] > symbols[lstart])[full]], minlength=c.n)]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes, over the columns of COUNTS."""
    n, c = F.col("n_words"), F.col
    letters = c("n_upper") + c("n_lower")
    return {
        "length": _vote(n < 10, n >= 40),
        "repeats": _vote(c("n_repeat_words") * 5 > n, (c("n_repeat_words") * 20 <= n) & (n >= 10)),
        "symbols": _vote(c("n_symbols") * 5 > n, (c("n_symbols") * 50 <= n) & (n >= 10)),
        "odd_words": _vote(c("n_odd_words") * 10 > n, (c("n_odd_words") * 50 <= n) & (n >= 10)),
        "odd_lines": _vote(c("n_odd_lines") * 2 > c("n_lines"), (c("n_odd_lines") == 0) & (n >= 10)),
        "lines": _vote(c("n_dup_lines") * 10 > c("n_lines") * 3, (c("n_dup_lines") == 0) & (c("n_lines") >= 3)),
        "capitals": _vote(c("n_upper") * 10 > letters * 3, (c("n_upper") * 10 <= letters) & (letters >= 40)),
        "word_length": _vote((c("word_chars") < n * 2) | (c("word_chars") > n * 14), (c("word_chars") >= n * 3) & (c("word_chars") <= n * 10) & (n >= 10)),
        "marks": _vote(c("n_marks") * 5 > n, (c("n_marks") * 50 <= n) & (n >= 10)),
        "vocabulary": _vote((c("n_distinct") * 10 < n) & (n >= 20), (c("n_distinct") * 4 > n) & (n >= 20)),
    }


def fit(votes: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior of good, accuracy of each rule's votes, and the posterior of each pattern (rows of ``votes``).

    A rule votes good, bad or not at all with one set of probabilities on good and one on
    bad documents: its bad votes may be far more telling than its good ones. The first
    posterior is the share of good among the votes. Pseudo-documents keep every
    probability off 0 and 1; a vote never counts against its meaning, and abstaining
    counts for nothing. A pattern without votes has the prior.
    """
    voted = votes != 0
    each = np.stack([votes == v for v in (-1, 1)], 2).astype(float)
    q = ((votes == 1).sum(1) + 0.5) / (voted.sum(1) + 1.0)
    prior, chance = 0.5, np.zeros((2, votes.shape[1], 2))
    for _ in range(rounds):
        for k, z in enumerate((q, 1 - q)):
            share = (each * (z * weight)[:, None, None]).sum(0) + (PSEUDO if k == 0 else PSEUDO[::-1])
            chance[k] = share / ((z * weight).sum() + PSEUDO_TOTAL)
        prior = float(np.clip((q * weight).sum() / max(weight.sum(), 1), 0.02, 0.98))
        told = np.log(chance[0] / chance[1])
        told = np.column_stack([np.minimum(told[:, 0], 0), np.maximum(told[:, 1], 0)])
        q = 1 / (1 + np.exp(-np.clip((each * told).sum((1, 2)) + np.log(prior / (1 - prior)), -50, 50)))
    right = (each * np.stack([1 - q, q], 1)[:, None, :] * weight[:, None, None]).sum((0, 2))
    return prior, right / np.maximum((voted * weight[:, None]).sum(0), 1e-9), q


def judge(df: DataFrame, keep: list[str], text: str = "text", least: float = 0.5) -> DataFrame:
    """``keep`` columns, the counts, base_failed, one vote column ``vote_<rule>`` each, posterior, kept.

    Null and empty texts have zero counts and fail the base rule; repeated rows are
    counted and judged alike; an empty table gives an empty result. ``keep`` must not
    clash with the new names.
    """
    spark = df.sparkSession
    counted = map_texts(df, text, keep, COUNTS, text_counts)
    named = rules()
    voted = counted.withColumns({"base_failed": base_failed()} | {f"vote_{k}": v for k, v in named.items()})
    votes = [f"vote_{k}" for k in named]
    seen = voted.groupBy(*votes).count().collect()
    if not seen:
        return voted.withColumns({"posterior": F.lit(0.0), "kept": F.lit(False)})
    _, _, q = fit(np.array([[r[v] for v in votes] for r in seen]), np.array([r["count"] for r in seen], float))
    known = spark.createDataFrame([(*[r[v] for v in votes], float(p)) for r, p in zip(seen, q, strict=True)],
                                  ", ".join(f"{v} int" for v in votes) + ", posterior double")
    out = voted.join(F.broadcast(known), votes)  # at most 3 ** rules patterns
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    out = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


QUERIES = {"op6_weak_supervision": op6_weak_supervision}
