"""Queries and DuckDB oracles of the training-data operators."""

from __future__ import annotations

from latticework.llm import bitplanes, decontaminate, exact_dedup, hard_negatives, html_text, language_id, line_dedup, ngram_join, packing, substring_dedup, toxicity, vector_codes, warc

_MODULES = (exact_dedup, line_dedup, language_id, toxicity, packing, warc, html_text, decontaminate, ngram_join, substring_dedup, vector_codes, hard_negatives, bitplanes)


def queries() -> dict:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
