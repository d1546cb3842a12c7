"""Queries over tables with nulls and keys that the small tables lack, each against its SQL in DuckDB."""

import duckdb
import pytest

from larkspur.plans import registry


@pytest.fixture
def answers(spark, tmp_path):
    """answers(name, table=SQL of its rows, ...): sorted rows of the query and of its SQL."""

    def made(name, **tables):
        con = duckdb.connect()
        for of, rows in tables.items():
            con.sql(f"COPY ({rows}) TO '{tmp_path}/{of}.parquet' (FORMAT parquet)")
            con.sql(f"CREATE VIEW {of} AS SELECT * FROM '{tmp_path}/{of}.parquet'")
        frame, answer = registry.queries()[name](spark, str(tmp_path)), con.sql(registry.oracle_sql()[name])
        assert frame.columns == answer.columns
        return sorted(map(tuple, frame.collect()), key=repr), sorted(answer.fetchall(), key=repr)

    return made


def test_sum_of_products_beyond_64_bits(answers):
    keys = [102_481, 102_482, 150_000, -(2**63), None, 2**63 - 1, 2**63 - 1]
    lines = ", ".join(f"('{'RAN'[i % 3]}', {'NULL' if k is None else k})" for i, k in enumerate(keys))
    got, want = answers("sum_bigint_decimal", lineitem=f"SELECT f AS l_returnflag, CAST(k AS BIGINT) AS l_orderkey FROM (VALUES {lines}, ('X', NULL)) t(f, k)")
    assert got == want
    assert ("X", None) in got


#: Orders with nulls in every column, ties, negative keys, and a customer's key that is alone in its status.
ORDERS = "SELECT CAST(k AS BIGINT) AS o_orderkey, s AS o_orderstatus, CAST(c AS BIGINT) AS o_custkey FROM (VALUES (1, 'O', 44), (2, 'O', 4), (NULL, 'O', 4), (3, 'O', NULL), (NULL, 'O', NULL), (-5, 'F', -3), (6, 'F', 37), (7, 'F', 37), (NULL, 'F', 39), (8, NULL, 5), (9, NULL, 45), (10, 'P', NULL), (11, 'Q', 15)) t(k, s, c)"


def plan_of(name, spark):
    return registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_first_and_last_rows_of_partitions(spark, answers):
    got, want = answers("first_last_value", orders=ORDERS)
    assert got == want
    # a frame to the partition's end would be read again for each row
    assert "Window" not in plan_of("first_last_value", spark)


def test_sums_from_peers_to_the_end(spark, answers):
    got, want = answers("frame_range_unbounded", orders=ORDERS)
    assert got == want
    # the rows meet in no window, only their sums do
    window = plan_of("frame_range_unbounded", spark).partition("Window [")[2]
    assert "unboundedpreceding$(), currentrow$()" in window.splitlines()[0] and "HashAggregate" in window


NO_LINES = "SELECT CAST(1 AS BIGINT) AS l_partkey, 50.0::DOUBLE AS l_quantity WHERE false"


@pytest.mark.parametrize("name", ["anti_not_in", "anti_not_in_with_null"])
@pytest.mark.parametrize("lines", [NO_LINES, "SELECT unnest([2, 3, 3, 7]) AS l_partkey, 50.0::DOUBLE AS l_quantity", "SELECT unnest([2, NULL]) AS l_partkey, 50.0::DOUBLE AS l_quantity", "SELECT unnest([1, 2]) AS l_partkey, 50.0::DOUBLE AS l_quantity"])
def test_not_in_of_no_rows_and_of_nulls(answers, name, lines):
    got, want = answers(name, part="SELECT unnest([1, 1, 2, 3, 4, NULL])::BIGINT AS p_partkey", lineitem=f"SELECT l_partkey::BIGINT AS l_partkey, l_quantity FROM ({lines})")
    assert got == want


@pytest.mark.parametrize("name", ["anti_not_in", "anti_not_in_with_null"])
def test_not_in_sends_no_table_through_the_driver(spark, name):
    bounds = {"spark.sql.maxBroadcastTableSize": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in bounds.items():
        spark.conf.set(k, v)
    try:
        rows, plan = registry.queries()[name](spark, "/root/testdata/sf0.001").collect(), plan_of(name, spark)
    finally:
        for k in bounds:
            spark.conf.unset(k)
    assert bool(rows) == (name == "anti_not_in")
    # small tables with a null are given up when it is met, large ones when memory is asked for: the plan tells
    assert "BroadcastHashJoin" not in plan
