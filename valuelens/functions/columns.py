"""Small, JVM-side column expressions shared by the operators.

Nothing here runs Python per row: each helper composes ``pyspark.sql.functions``
so the expressions stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column, digits: int = 6) -> Column:
    """Round a double for stable output; ``+ 0.0`` turns -0.0 into 0.0."""
    return F.round(col_of(c).cast("double"), digits) + F.lit(0.0)


# Fixed value: the whitespace set of Python's str.strip for ASCII text.
WHITESPACE = " \t\n\r\x0b\x0c"


def strip_whitespace(c: str | Column) -> Column:
    """Trim every kind of leading/trailing ASCII whitespace (``trim`` strips spaces only)."""
    return F.btrim(col_of(c), F.lit(WHITESPACE))


def is_close_to_integer(x: str | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """NumPy ``isclose(x, round(x))`` with its default tolerances."""
    x = col_of(x)
    nearest = F.rint(x)
    return F.abs(x - nearest) <= F.lit(atol) + F.lit(rtol) * F.abs(nearest)


def hash_index(*parts: str | Column) -> Column:
    """Deterministic non-negative 60-bit integer from md5 of the parts.

    Equals ``('0x' || substr(md5(concat_ws('|', ...)), 1, 15))::BIGINT`` in DuckDB,
    so sampling and permutation orders can be reproduced by an SQL oracle.
    """
    text = F.concat_ws("|", *[col_of(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
