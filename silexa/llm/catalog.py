"""All registered queries of this subpackage and their SQL."""
from __future__ import annotations

from . import queries_lots, queries_packing, queries_rates, queries_terms, queries_text, queries_vectors

QUERIES: dict = {}
SQL: dict = {}
for _m in (queries_terms, queries_rates, queries_lots, queries_packing, queries_text, queries_vectors):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
