"""All queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from kgspark.llm import cooccurrence, leakage, names, neighbours, packing, pairs, pii, quality, similar_sets

MODULES = (cooccurrence, quality, packing, leakage, similar_sets, neighbours, pii, pairs, names)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
