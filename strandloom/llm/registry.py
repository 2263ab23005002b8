"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from . import class_lm, contamination, exact_dedup, lines, mixing, near_dedup, passages, token_files, toxicity, warc

MODULES = (mixing, exact_dedup, class_lm, contamination, passages, toxicity, warc, lines, near_dedup, token_files)

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
