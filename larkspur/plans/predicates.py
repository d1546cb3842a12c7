"""Comparisons, three-valued logic, lists, rows, patterns, CASE."""

from pyspark.sql import functions as F

from ..operators.relational import all_of, any_of, row_less
from ..sources.tables import table
from .registry import query, sql

#: Integers with nulls, made of keys.
N = "(SELECT o_orderkey AS k, NULLIF(CAST(o_custkey % 7 AS INT), 3) AS a, NULLIF(CAST(o_orderkey % 5 AS INT), 2) AS b, o_orderstatus AS s FROM {orders}) AS t"
NB = N.replace("{orders}", "orders")

sql("cmp_same_type", f"SELECT k, a = b AS eq, a <> b AS ne, a < b AS lt, a <= b AS le, a > b AS gt, a >= b AS ge FROM {N}")
sql("cmp_mixed_numeric", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(12,2)) > l_linenumber * 5 AS m, CAST(l_linenumber AS DOUBLE) < CAST(l_quantity AS DECIMAL(12,2)) AS d FROM {lineitem}")
sql("is_distinct_from", f"SELECT k, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS e FROM {N}")
sql("bool_three_valued", f"SELECT k, (a > 2 AND b > 1) AS x, (a > 2 OR b > 1) AS y, NOT (a > 2) AS z FROM {N}")
sql("is_null_tests", f"SELECT k FROM {N} WHERE a IS NULL OR b IS NOT NULL AND k % 3 = 0")
sql("boolean_tests_six_forms", f"SELECT k, (a > 2) IS TRUE AS t, (a > 2) IS NOT TRUE AS nt, (a > 2) IS FALSE AS f, (a > 2) IS NOT FALSE AS nf, (a > 2) IS UNKNOWN AS u, (a > 2) IS NOT UNKNOWN AS nu FROM {N}", f"SELECT k, (a > 2) IS TRUE AS t, (a > 2) IS NOT TRUE AS nt, (a > 2) IS FALSE AS f, (a > 2) IS NOT FALSE AS nf, (a > 2) IS NULL AS u, (a > 2) IS NOT NULL AS nu FROM {NB}")
sql("between", f"SELECT k FROM {N} WHERE a BETWEEN 2 AND 4 AND b NOT BETWEEN 1 AND 2")
sql("in_list", f"SELECT k, a IN (1, 2, 6) AS i, a NOT IN (1, NULL) AS n FROM {N}")
sql("like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%ring%' AND p_name LIKE '_e%'")
sql("not_like", "SELECT p_partkey FROM {part} WHERE p_name NOT LIKE 's%'")
sql("ilike", "SELECT p_partkey FROM {part} WHERE p_type ILIKE 'pro%' OR p_name NOT ILIKE '%G%'")
sql("regex_match", "SELECT p_partkey FROM {part} WHERE p_brand RLIKE '^Brand#[12][0-3]$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[12][0-3]$')")
sql("regex_not_match", "SELECT p_partkey FROM {part} WHERE NOT (p_name RLIKE 'r.*g')", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, 'r.*g')")
sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS w FROM {orders}")
sql("case_searched", f"SELECT k, CASE WHEN a > b THEN 'more' WHEN a = b THEN 'same' WHEN a IS NULL THEN 'none' ELSE 'less' END AS w FROM {N}")
sql("coalesce", f"SELECT k, COALESCE(a, b, -1) AS c FROM {N}")
sql("nullif", f"SELECT k, NULLIF(a, b) AS c FROM {N}")


def _n(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("k"), F.nullif((F.col("o_custkey") % 7).cast("int"), F.lit(3)).alias("a"), F.nullif((F.col("o_orderkey") % 5).cast("int"), F.lit(2)).alias("b"))


@query("op_any_array", f"SELECT k, (a = 1 OR a = b) AS x, (a > 4 OR a > b) AS y FROM {NB}")
def op_any_array(spark, sf_dir):
    return _n(spark, sf_dir).select("k", any_of(F.col("a"), [F.lit(1), F.col("b")], lambda x, y: x == y).alias("x"), any_of(F.col("a"), [F.lit(4), F.col("b")], lambda x, y: x > y).alias("y"))


@query("op_all_array", f"SELECT k, (a <> 1 AND a <> b) AS x, (a >= 2 AND a >= b) AS y FROM {NB}")
def op_all_array(spark, sf_dir):
    return _n(spark, sf_dir).select("k", all_of(F.col("a"), [F.lit(1), F.col("b")], lambda x, y: x != y).alias("x"), all_of(F.col("a"), [F.lit(2), F.col("b")], lambda x, y: x >= y).alias("y"))


@query("row_compare_eq", f"SELECT k, (a = 1 AND b = 4) AS e, (a <> 1 OR b <> 4) AS n FROM {NB}")
def row_compare_eq(spark, sf_dir):
    from ..operators.relational import row_equal

    pair = [F.col("a"), F.col("b")], [F.lit(1), F.lit(4)]
    return _n(spark, sf_dir).select("k", row_equal(*pair).alias("e"), (~row_equal(*pair)).alias("n"))


@query("row_compare_lt_nulls", f"SELECT k, (a < 4 OR (a = 4 AND b < 3)) AS l, (a < 4 OR (a = 4 AND b <= 3)) AS le FROM {NB}")
def row_compare_lt_nulls(spark, sf_dir):
    pair = [F.col("a"), F.col("b")], [F.lit(4), F.lit(3)]
    return _n(spark, sf_dir).select("k", row_less(*pair).alias("l"), row_less(*pair, or_equal=True).alias("le"))

