"""Queries of this package and their DuckDB SQL."""

from __future__ import annotations

from . import (
    divergence,
    embedding_dedup,
    fair_mix,
    line_crf,
    merkle,
    ngram_join,
    packing,
    piece_sampling,
    quality_rules,
    sharding,
    suffix_dedup,
    toxicity,
    url_filter,
)

_MODULES = [sharding, url_filter, ngram_join, toxicity, piece_sampling, quality_rules, embedding_dedup, suffix_dedup, packing, line_crf, fair_mix, merkle, divergence]


def pipeline(spark, sf_dir):
    import corpus_pipeline  # at the repository's top; it imports this package

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out | {"pipeline": pipeline}


def oracle_sql() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(getattr(m, "SQL", {}))
    return out
