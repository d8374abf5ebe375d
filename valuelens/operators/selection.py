"""Exact order statistics without a sort: distributed selection by pivots.

A top fraction, a decile, a tier or a conformal correction needs a few *cut points* of an
order, not every row's rank.  Each round takes a sample of at most ``SAMPLE`` rows (those
with the least hash) among the rows that may still be a cut.  Where these are all such
rows, the cuts are read off.  Otherwise ``PIVOTS`` quantiles of the sample part the rows,
and those between neighbouring pivots and on them are counted: one aggregation with partial
sums, at most 2 * PIVOTS + 1 groups, whatever the number of rows.  A wanted rank that falls
on a pivot is found; one that falls between two pivots goes on with the rows there, about
1 / PIVOTS of them.  The rows themselves never move, and nothing is written.

Every round leaves out at least the pivots, so the search ends for any data; ties of a
value are told apart by the key, and rows that repeat score and key altogether leave
together with the pivot that equals them.  The cuts of 10^9 rows take three or four rounds.

Order: score (nulls first ascending, last descending; NaN above every number), then the
keys ascending, nulls first, as ``ORDER BY`` does.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most pivots of one round; they are held as a literal of the plan.
PIVOTS = 1023
#: Most bins whose rows are told by comparing with the bins' ends; with more, each row's bin is searched.
COMPARED = 16
#: Most rows that a round's sample brings to the driver.
SAMPLE = 1 << 15


def _sort_columns(score: str, keys: Sequence[str], descending: bool) -> list[Column]:
    """Columns whose ascending order is the wanted one."""
    s = F.col(score)
    if not descending:
        return [s, *[F.col(k) for k in keys]]
    return [s.isNull(), ~F.coalesce(F.isnan(s.cast("double")), F.lit(False)), F.negative(s), *[F.col(k) for k in keys]]


#: Types whose JSON form is a bare token; any other is a JSON string.
_BARE = ("tinyint", "smallint", "int", "bigint", "boolean", "float", "double", "decimal")


def _literal(rows: Sequence[Sequence[str | None]], types: Sequence[str]) -> Column:
    """Array of structs from texts that Spark's own cast to string made.

    One text that the optimizer parses once: a literal of the plan, whatever its length.
    """
    def one(text: str | None, kind: str) -> str:
        if text is None:
            return "null"
        bare = kind.startswith(_BARE) and text not in ("NaN", "Infinity", "-Infinity")
        return text if bare else json.dumps(text)

    body = "[" + ",".join("{" + ",".join(f'"c{i}":{one(v, types[i])}' for i, v in enumerate(row)) + "}" for row in rows) + "]"
    schema = "array<struct<" + ",".join(f"c{i}:{t}" for i, t in enumerate(types)) + ">>"
    return F.from_json(F.lit(body), schema, {"prefersDecimal": "false", "mode": "FAILFAST"})


def _at_most(pivots: Column, count: int, row: Column) -> Column:
    """Number of the ascending ``pivots`` that are <= ``row``: a binary search, by lookups in a literal."""
    steps = [1 << b for b in reversed(range(count.bit_length()))]

    def advance(pos: Column, step: Column) -> Column:
        fits = (pos + step <= F.lit(count)) & F.coalesce(F.get(pivots, pos + step - 1) <= row, F.lit(False))
        return F.when(fits, pos + step).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def _between(bins: Sequence[int], pivots: list[tuple[str | None, ...]], types: Sequence[str], row: Column) -> Column:
    """Whether ``row`` lies in one of the even ``bins``: strictly between its two pivots, compared with these only."""
    inside = F.lit(False)
    for b in bins:
        ends = pivots[max(b // 2 - 1, 0):b // 2 + 1]           # the first and the last bin have one end
        literal = _literal(ends, types)
        part = F.lit(True)
        if b // 2 > 0:
            part = part & (row > F.get(literal, F.lit(0)))
        if b // 2 < len(pivots):
            part = part & (row < F.get(literal, F.lit(len(ends) - 1)))
        inside = inside | F.coalesce(part, F.lit(False))
    return inside


class Cuts:
    """Cut points of one order, found at wanted ranks; ``place`` tells a row's place among them."""

    def __init__(self, n: int, sort: list[Column], types: list[str], rows: list[tuple[str | None, ...]]):
        self.n, self.rows, self._sort, self._types = n, rows, sort, types

    def place(self) -> Column:
        """Number of cuts that lie strictly before the row: 0 up to the first cut, itself included."""
        if not self.rows:
            return F.lit(0)
        distinct = list(dict.fromkeys(self.rows))
        row = F.struct(*self._sort)
        cuts = _literal(distinct, self._types)
        upto = _at_most(cuts, len(distinct), row)
        strictly = F.when(F.coalesce(F.get(cuts, upto - 1) == row, F.lit(False)), upto - 1).otherwise(upto)
        if len(distinct) == len(self.rows):
            return strictly
        ahead = [0]                 # several wanted ranks may share one cut
        for cut in distinct:
            ahead.append(ahead[-1] + self.rows.count(cut))
        return F.get(F.array(*[F.lit(a) for a in ahead]), strictly)

    def scores(self, descending: bool = False) -> list[float | None]:
        """The cuts' scores, as doubles."""
        texts = [row[2 if descending else 0] for row in self.rows]
        values = [None if t is None else float(t.replace("Infinity", "inf")) for t in texts]
        return [None if v is None else 0.0 - v for v in values] if descending else values


def _checked(ranks: Sequence[int], n: int) -> list[int]:
    out = [int(r) for r in ranks]
    if any(not 1 <= r <= n for r in out) or out != sorted(out):
        raise ValueError(f"ranks must ascend between 1 and {n}")
    return out


def find_cuts(df: DataFrame, score: str, keys: Sequence[str], ranks: Callable[[int], Sequence[int]],
              descending: bool = False, pivots: int = PIVOTS, sample_rows: int = SAMPLE) -> Cuts:
    """Rows at the 1-based, non-decreasing ``ranks(n)`` of the order by ``score``, then ``keys``.

    ``ranks`` gets the number of rows; ranks beyond it are refused.  An empty frame has no
    cuts.  The frame is read twice a round, so a costly one is best stored first.
    """
    sort = _sort_columns(score, keys, descending)
    parts = df.select(*[c.alias(f"c{i}") for i, c in enumerate(sort)])
    types = [f.dataType.simpleString() for f in parts.schema.fields]
    cols = parts.columns
    texts = [F.col(c).cast("string").alias(c) for c in cols]
    row = F.struct(*cols)
    n, order, found = None, [], {}
    open_rows, open_at = parts, {}             # wanted rank -> its rank among the rows that are still open
    while True:
        sample = open_rows.orderBy(F.xxhash64(*cols), *cols).limit(sample_rows).orderBy(*cols).select(*texts)
        drawn = [tuple("0.0" if v == "-0.0" else v for v in r) for r in sample.collect()]
        if not drawn and n is None:
            return Cuts(0, sort, types, [])
        if len(drawn) < sample_rows:           # these are all open rows, in order
            if n is None:
                order = _checked(ranks(len(drawn)), len(drawn))
                n, open_at = len(drawn), {r: r for r in order}
            found.update({r: drawn[inside - 1] for r, inside in open_at.items()})
            return Cuts(n, sort, types, [found[r] for r in order])
        step = pivots + 1
        texts_of = list(dict.fromkeys(drawn[i * len(drawn) // step] for i in range(1, step)))
        literal = _literal(texts_of, types)
        upto = _at_most(literal, len(texts_of), row)
        on = F.coalesce(F.get(literal, upto - 1) == row, F.lit(False))
        place = F.when(on, 2 * upto - 1).otherwise(2 * upto)       # odd: on a pivot, even: between two
        counts = dict(open_rows.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        bins = sorted(counts)
        ends = []
        for b in bins:
            ends.append((ends[-1] if ends else 0) + counts[b])
        if n is None:
            n = ends[-1]
            order = _checked(ranks(n), n)
            open_at = {r: r for r in order}
        still, keep = {}, set()
        for r, inside in open_at.items():
            i = bisect_left(ends, inside)
            b = bins[i]
            if b % 2:
                found[r] = texts_of[(b - 1) // 2]
            else:
                keep.add(b)
                still[r] = (i, inside)
        if not still:
            return Cuts(n, sort, types, [found[r] for r in order])
        # the kept bins lie one after the other again: ranks lose the rows of the bins that go
        dropped, gone = {}, 0
        for b in bins:
            dropped[b] = gone
            if b not in keep:
                gone += counts[b]
        open_at = {r: inside - dropped[bins[i]] for r, (i, inside) in still.items()}
        open_rows = open_rows.where(_between(sorted(keep), texts_of, types, row) if len(keep) <= COMPARED
                                    else place.isin(sorted(keep)))
