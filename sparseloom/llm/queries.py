"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from sparseloom.llm import bpe, collocations, decontaminate, hard_negatives, html_text, jaccard_join, language, line_dedup, pseudo_likelihood, quality, quality_mil, records, substring_dedup

MODULES = (records, quality, jaccard_join, substring_dedup, language, line_dedup, bpe, decontaminate, html_text, pseudo_likelihood, quality_mil, collocations, hard_negatives)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
