"""Joins of every kind, subqueries."""

from pyspark.sql import functions as F

from ..functions.text import bpchar, bpchar_key
from ..operators.relational import not_in
from ..sources.tables import tables
from .registry import query, sql

#: Customers and orders that do not all meet: one side has keys that the other lacks, and null keys.
C = "(SELECT NULLIF(c_custkey, 9) AS ck, c_nationkey AS nk FROM {customer}) AS c"
O = "(SELECT o_orderkey AS ok, NULLIF(o_custkey + 30, 40) AS ock, o_orderstatus AS st FROM {orders}) AS o"

sql("inner_equi", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_acctbal > 8000")
sql("inner_equi_residual", "SELECT l_orderkey, l_linenumber, o_orderkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_quantity > 48")
sql("inner_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM {nation} AS a JOIN {nation} AS b ON a.n_regionkey <= b.n_regionkey AND a.n_nationkey > b.n_nationkey")
sql("cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql("comma_join", "SELECT r_name, n_name FROM {region}, {nation} WHERE r_regionkey = n_regionkey")
sql("left", f"SELECT ck, ok FROM {C} LEFT JOIN {O} ON ck = ock")
sql("left_on_residual", f"SELECT ck, ok FROM {C} LEFT JOIN {O} ON ck = ock AND st = 'F'")
sql("right", f"SELECT ck, ok FROM {C} RIGHT JOIN {O} ON ck = ock")
sql("full", f"SELECT ck, ok FROM {C} FULL JOIN {O} ON ck = ock")
sql("full_theta", "SELECT a.r_regionkey AS x, n_nationkey AS y FROM {region} AS a FULL JOIN {nation} ON a.r_regionkey > n_regionkey + 2")
sql("full_on_false", "SELECT r_regionkey AS x, n_nationkey AS y FROM {region} FULL JOIN {nation} ON 1 = 0")
sql("using", "SELECT k, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM {region}) AS r JOIN (SELECT n_regionkey AS k, n_name FROM {nation}) AS n USING (k)")
sql("natural", "SELECT k, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM {region}) AS r NATURAL JOIN (SELECT n_regionkey AS k, n_name FROM {nation}) AS n")
sql("self_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM {nation} AS a JOIN {nation} AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("semi_exists_equi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql("semi_exists_nonequi", "SELECT n_nationkey FROM {nation} WHERE EXISTS (SELECT 1 FROM {region} WHERE r_regionkey * 6 < n_nationkey AND r_regionkey > n_regionkey)")
sql("semi_in_correlated", "SELECT o_orderkey FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_shipdate > o_orderdate AND l_quantity > 49)")
sql("semi_in_uncorrelated", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49)")
sql("anti_not_exists", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sql("scalar_subquery_where", "SELECT s_suppkey FROM {supplier} WHERE CAST(s_acctbal AS DECIMAL(18,2)) > (SELECT CAST(max(c_acctbal) AS DECIMAL(18,2)) - 1000 FROM {customer})")
sql("scalar_subquery_select", "SELECT r_regionkey, (SELECT CAST(count(*) AS BIGINT) FROM {nation}) AS n FROM {region}")
sql("scalar_subquery_having", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_orderstatus HAVING count(*) > (SELECT count(*) / 2 FROM {customer})")
sql("scalar_subquery_zero_rows", "SELECT n_nationkey, (SELECT r_name FROM {region} WHERE r_regionkey = 77) AS none FROM {nation}")
sql("correlated_scalar", "SELECT c_custkey, (SELECT CAST(count(*) AS BIGINT) FROM {orders} WHERE o_custkey = c_custkey) AS n FROM {customer}")
sql("bloom_candidate_join", "SELECT o_orderkey, l_linenumber FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_totalprice > 490000 AND o_orderstatus = 'P'")


@query("anti_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def anti_not_in(spark, sf_dir):
    part, lineitem = tables(spark, sf_dir, "part", "lineitem")
    return not_in(part.select("p_partkey"), "p_partkey", lineitem.where("l_quantity > 40").select("l_partkey"))


@query("anti_not_in_with_null", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT NULLIF(l_partkey, 1) FROM lineitem)")
def anti_not_in_with_null(spark, sf_dir):
    part, lineitem = tables(spark, sf_dir, "part", "lineitem")
    return not_in(part.select("p_partkey"), "p_partkey", lineitem.select(F.nullif("l_partkey", F.lit(1).cast("bigint"))))


@query("bpchar_join_key", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON rtrim(rpad(substr(a.n_name, 1, 8), 12, ' ')) = rtrim(rpad(substr(b.n_name, 1, 8), 10, ' '))")
def bpchar_join_key(spark, sf_dir):
    """char(12) joined to char(10): trailing blanks do not count."""
    (nation,) = tables(spark, sf_dir, "nation")
    a = nation.select(F.col("n_nationkey").alias("x"), bpchar(F.substring("n_name", 1, 8), 12).alias("p"))
    b = nation.select(F.col("n_nationkey").alias("y"), bpchar(F.substring("n_name", 1, 8), 10).alias("q"))
    return a.join(b, bpchar_key(a.p) == bpchar_key(b.q)).select("x", "y")
