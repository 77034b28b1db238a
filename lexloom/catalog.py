"""All queries of the wordlist operators, and their SQL."""

from __future__ import annotations

from lexloom import queries, queries_history, queries_ingest, queries_logs

_MODULES = (queries, queries_ingest, queries_history, queries_logs)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
