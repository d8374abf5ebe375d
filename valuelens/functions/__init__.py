"""Column-expression helpers; every helper returns a built-in Spark Column."""

from .columns import (  # noqa: F401
    hash_index,
    is_close_to_integer,
    r6,
    strip_whitespace,
)
