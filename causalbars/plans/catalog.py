"""All queries of the core and the SQL that gives the same rows."""

from __future__ import annotations

from causalbars.plans import data_queries, study_queries

MODULES = [data_queries, study_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
