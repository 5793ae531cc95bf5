"""Named queries over the tables and the SQL that gives the same rows."""

from __future__ import annotations

from sourcewise.plans import audit_queries, curation_queries, evidence_queries, model_queries, report_queries, space_queries
from sourcewise.plans.book import ORACLE_SQL, QUERIES


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL


__all__ = ["audit_queries", "curation_queries", "evidence_queries", "model_queries", "oracle_sql", "queries", "report_queries", "space_queries"]
