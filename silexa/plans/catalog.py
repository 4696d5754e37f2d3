"""All registered core queries and their SQL."""
from __future__ import annotations

from . import evaluation, formats, functions, graphs, models, statistics, texts

QUERIES: dict = {}
SQL: dict = {}
for _m in (statistics, evaluation, texts, graphs, formats, functions, models):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
