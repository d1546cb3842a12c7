"""Every registered query of the engine against its SQL in DuckDB, over the small tables."""

from pathlib import Path

import duckdb
import pytest

from larkspur.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(names, order, rows):
    at = [names.index(c) for c in order]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    order = sorted(frame.columns)
    got = rows_of(frame.columns, order, [tuple(r) for r in frame.collect()])
    if name not in ORACLE:
        assert got
        return
    answer = duck.sql(ORACLE[name])
    assert sorted(answer.columns) == order
    assert got == rows_of(answer.columns, order, answer.fetchall())
