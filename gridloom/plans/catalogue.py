"""The registered queries and the SQL that each must equal."""

from __future__ import annotations

from gridloom.plans import feed_queries, grid_queries, overlay_queries, relational_queries, retrieval_queries, series_queries
from gridloom.plans.base import Query

BOOKS = (series_queries.book, relational_queries.book, grid_queries.book, overlay_queries.book, retrieval_queries.book, feed_queries.book)


def queries() -> dict[str, Query]:
    return {k: q for b in BOOKS for k, q in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for b in BOOKS for k, s in b.sql.items()}
