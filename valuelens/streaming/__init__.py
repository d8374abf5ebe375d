"""Incremental (Structured Streaming) variant of the canonical ingest.

The reference is batch only; this package runs the same transaction contract
(A1-A3, B3-B8) over source files as they arrive, with exactly-once output.
"""

from .ingest import start_canonical_ingest  # noqa: F401
