"""Named queries over the tables, and the SQL that they are checked against."""

from .catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
