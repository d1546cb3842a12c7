"""Queries over expressions have a row for each row of their table; test_queries.py holds each against its SQL."""

import subprocess
import sys
from pathlib import Path

import pytest

from larkspur.plans import registry

FOLDER = "/root/testdata/sf0.001"
ORDERS = ["cmp_same_type", "is_distinct_from", "bool_three_valued", "boolean_tests_six_forms", "in_list", "case_searched", "coalesce", "nullif", "op_any_array", "op_all_array", "row_compare_eq", "row_compare_lt_nulls", "derived_table_rename", "order_multi_nulls", "interval_to_text"]
LINES = ["cmp_mixed_numeric", "int_add_checked", "int_div_trunc", "modulo_sign", "shifts", "unary_minus", "decimal_scale_add", "decimal_scale_div", "abs", "round_numeric", "trunc_float", "hyperbolic_six", "power", "float_to_int", "text_casts"]
PARTS = ["concat_op", "concat_ws", "length_bpchar", "reverse", "format_basic", "format_dynamic", "quote_literal", "varchar_cast", "array_subscript"]


def test_no_query_is_bound_to_low_keys():
    bounded = [n for n, text in registry.oracle_sql().items() if "orderkey < " in text or "partkey < " in text or "custkey < " in text]
    assert set(bounded) <= {"self_join"}


@pytest.mark.parametrize("of,names", [("orders", ORDERS), ("lineitem", LINES), ("part", PARTS)])
def test_rows_of_the_whole_table(spark, of, names):
    rows = spark.read.parquet(f"{FOLDER}/{of}.parquet").count()
    assert {n: registry.queries()[n](spark, FOLDER).count() for n in names} == dict.fromkeys(names, rows)


@pytest.mark.parametrize("name", ["left", "left_on_residual", "right", "full"])
def test_outer_joins_keep_every_row(spark, name):
    rows = registry.queries()[name](spark, FOLDER).collect()
    customers, orders = (spark.read.parquet(f"{FOLDER}/{x}.parquet").count() for x in ("customer", "orders"))
    if name != "right":
        assert len({r.ck for r in rows if r.ck is not None}) == customers - 1
    if name in ("right", "full"):
        assert len({r.ok for r in rows if r.ok is not None}) == orders


def test_bloom_filter_in_the_plan(spark):
    """Run-time Bloom filters come in where the filtered side is large; the bounds are lowered to see one on small tables."""
    keys = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        plan = registry.queries()["bloom_candidate_join"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert "might_contain" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.queries()["scan_filter_pushdown"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan
    assert "l_extendedprice" not in plan


def test_entry_without_the_corpus_operators_libraries():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()) > 200, 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True, timeout=120)
    assert out.stdout.split()[-2:] == ["True", "False"]
