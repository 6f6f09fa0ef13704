"""All queries over the reference operators, and the SQL that gives the same rows."""

from __future__ import annotations

from gleaner.queries import components, copy_checks, files, gone, history_queries, level_queries, manifest_queries, order_queries, page_queries, rule_queries, scan_queries, traction_queries  # noqa: F401
from gleaner.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
