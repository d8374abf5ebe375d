"""Snapshot-date parameters as Spark literals.

Snapshot dates are a short, driver-side configuration list (tens of dates), so they
travel as a literal array inside the expression: each fact row is routed to the
snapshots whose windows contain it with ``explode(filter(dates, ...))``. There is no
join, no broadcast and no shuffle, and the row fan-out is bounded by the number of
dates whose windows overlap.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_dates(dates: Sequence[str | dt.date]) -> list[dt.date]:
    out = []
    for d in dates:
        out.append(d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)[:10]))
    if not out:
        raise ValueError("at least one snapshot date is required")
    if len(set(out)) != len(out):
        raise ValueError("snapshot dates must be distinct")
    return sorted(out)


def date_array(dates: Sequence[dt.date]) -> Column:
    return F.array(*[F.lit(d.isoformat()).cast("date") for d in dates])


def route_to_snapshots(dates: Sequence[dt.date], keep: Callable[[Column], Column]) -> Column:
    """``explode`` of the snapshot dates ``s`` for which ``keep(s)`` holds."""
    return F.explode(F.filter(date_array(dates), keep))
