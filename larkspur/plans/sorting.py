"""Sort, limit, distinct, set operations."""

from pyspark.sql import functions as F

from ..functions.ordering import asc, desc
from ..operators.relational import distinct_on, limit
from ..operators.windows import row_numbers
from ..sources.tables import table
from .registry import query, sql

sql("limit", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 25")
sql("limit_offset", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_custkey DESC NULLS FIRST, o_orderkey LIMIT 10 OFFSET 30")
sql("offset_only", "SELECT n_nationkey FROM {nation} ORDER BY n_nationkey OFFSET 20")
sql("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
sql("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
sql("union_all", "SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region} UNION ALL SELECT n_regionkey FROM {nation}")
sql("union_distinct", "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region}")
sql("union_type_unify", "SELECT CAST(k AS DOUBLE) AS k FROM (SELECT n_nationkey AS k FROM {nation} UNION SELECT CAST(c_acctbal AS DECIMAL(12,2)) FROM {customer}) AS u")


@query("order_multi_nulls", "SELECT k, a, CAST(row_number() OVER (ORDER BY a DESC NULLS FIRST, k ASC NULLS LAST) AS BIGINT) AS place FROM (SELECT o_orderkey AS k, NULLIF(o_custkey % 7, 3) AS a FROM orders) AS t")
def order_multi_nulls(spark, sf_dir):
    """The default order of a descending key: nulls first. Places tell the order that a comparison of sets would not see."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.nullif(F.col("o_custkey") % 7, F.lit(3).cast("bigint")).alias("a"))
    return row_numbers(rows, "place", "a", desc("a"), [asc("k")]).orderBy(desc("a"), asc("k"))


@query("order_hidden_key", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def order_hidden_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(desc("c_acctbal"), asc("c_custkey")).limit(20).select("c_name")


@query("limit_null", "SELECT r_regionkey FROM region")
def limit_null(spark, sf_dir):
    return limit(table(spark, sf_dir, "region").select("r_regionkey"), None, None)


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on_best(spark, sf_dir):
    return distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], [desc("o_totalprice"), asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("distinct_on_hidden_sort", "SELECT DISTINCT ON (o_orderstatus) o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus, o_orderdate, o_custkey DESC, o_orderkey")
def distinct_on_hidden_sort(spark, sf_dir):
    return distinct_on(table(spark, sf_dir, "orders"), ["o_orderstatus"], [asc("o_orderdate"), desc("o_custkey"), asc("o_orderkey")]).select("o_orderstatus", "o_orderkey")
