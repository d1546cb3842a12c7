"""Statements in PostgreSQL's dialect, over Spark tables."""

from .dialect import UnsupportedFeature, pg_sql, translate

__all__ = ["UnsupportedFeature", "pg_sql", "translate"]
