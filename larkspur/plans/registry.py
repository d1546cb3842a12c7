"""All queries of the engine by name, with the SQL that a reference database answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import bare, statement

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under `name`, with the SQL for the same rows if there is any."""

    def put(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are called {name}")
        _queries[name] = function
        if oracle is not None:
            _oracle[name] = oracle
        return function

    return put


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a statement with tables written {name}; the oracle is the same statement unless given."""
    query(name, bare(text) if oracle is None else oracle)(lambda spark, sf_dir: statement(spark, sf_dir, text))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
