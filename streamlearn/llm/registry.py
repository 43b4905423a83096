"""Queries and DuckDB SQL of this package."""

from __future__ import annotations

from streamlearn.llm import ann, chat, decontaminate, divergence, license_scan, line_dedup, ngram, packing, pii, quality, repair, simhash, toxicity

_MODULES = [chat, ann, simhash, toxicity, license_scan, pii, packing, decontaminate, ngram, quality, line_dedup, repair, divergence]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
