"""Query registry: name -> (Spark callable, DuckDB oracle SQL or absent)."""

from __future__ import annotations

from . import q_contract, q_models, q_resampling, q_scoring, q_snapshots

_MODULES = [q_snapshots, q_scoring, q_contract, q_resampling, q_models]
FLAGSHIP = "policy_summary"


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(getattr(m, "SQL", {}))
    return out
