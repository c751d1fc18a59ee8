"""Named queries over the supplied tables, each with the SQL it is checked against."""

from rainloom.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
