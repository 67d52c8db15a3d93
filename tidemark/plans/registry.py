"""Every query of the library with its SQL counterpart."""

from __future__ import annotations

from tidemark.plans import bar_queries, join_queries, research_queries, source_queries, study_queries, trade_queries
from tidemark.plans.base import Query

FLAGSHIP = "breakout_candidates"
CATALOGS = [bar_queries.catalog, join_queries.catalog, trade_queries.catalog, study_queries.catalog, research_queries.catalog, source_queries.catalog]


def queries() -> dict[str, Query]:
    return {k: v for c in CATALOGS for k, v in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for c in CATALOGS for k, v in c.sql.items()}
