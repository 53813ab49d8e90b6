"""All queries of the corpus engine, by name, and their DuckDB equivalents."""

from __future__ import annotations

from lorewell.queries import corpus, dialogue, logs, results, retrieval, star, web
from lorewell.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpus", "dialogue", "logs", "results", "retrieval", "star", "web"]
