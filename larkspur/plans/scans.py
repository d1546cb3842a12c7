"""Scans, literals, derived tables, CTEs."""

from pyspark.sql import functions as F

from ..sources.tables import csv_line, table
from ..sql import pg_sql
from .registry import query, sql

sql("scan_project", "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM {orders}")
sql("scan_filter_pushdown", "SELECT l_orderkey, l_linenumber, l_returnflag FROM {lineitem} WHERE l_quantity > 45 AND l_shipdate >= DATE '1999-01-01' AND l_returnflag = 'R'")
sql("count_star_no_columns", "SELECT CAST(count(*) AS BIGINT) AS n FROM {lineitem}")
sql("values_literal", "SELECT CAST(a AS BIGINT) AS a, CAST(b AS DECIMAL(10,3)) AS b, c FROM (VALUES (1, 1.5, 'x'), (2, 2.125, NULL), (3, 3, 'z')) AS v(a, b, c)")
sql("no_from_select", "SELECT CAST(1 AS INT) AS one, 'text' AS t, CAST(NULL AS INT) AS nothing")
sql("const_false_empty", "SELECT n_nationkey, n_name FROM {nation} WHERE 1 = 0")
sql("derived_table_rename", "SELECT k, s FROM (SELECT o_orderkey, o_orderstatus FROM {orders}) AS d(k, s)")
sql("cte_single", "WITH big AS (SELECT c_custkey, c_nationkey FROM {customer} WHERE c_acctbal > 5000) SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM big GROUP BY c_nationkey")
sql("cte_multi_use", "WITH t AS (SELECT l_suppkey AS k, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS q FROM {lineitem} GROUP BY l_suppkey) SELECT a.k, a.q FROM t a WHERE a.q = (SELECT max(q) FROM t)")


@query("dual_row_marks", "SELECT r_regionkey, r_name FROM region")
def dual_row_marks(spark, sf_dir):
    """Row marks lock nothing here: rows are read from files that do not change."""
    return pg_sql(spark, "SELECT r_regionkey, r_name FROM region FOR UPDATE FOR SHARE", {"region": table(spark, sf_dir, "region")})


ODD = """CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN p_name || ',' || p_type WHEN 3 THEN 'a "' || p_name || '"' WHEN 4 THEN p_name || chr(10) || 'x' ELSE p_name END"""


@query("copy_out_csv", f"""SELECT p_partkey || ',' || CASE WHEN t IS NULL THEN '' WHEN t = '' OR regexp_matches(t, '[",\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END || ',' || CASE WHEN p_size > 20 THEN 't' ELSE 'f' END AS value FROM (SELECT *, {ODD} AS t FROM part) AS p""")
def copy_out_csv(spark, sf_dir):
    """The lines that COPY (SELECT ...) TO writes: nulls, empty texts, delimiters, quotes and line ends."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(ODD).alias("t"), (F.col("p_size") > 20).alias("large"))
    return part.select(csv_line(part).alias("value"))


@query("explain_forms")
def explain_forms(spark, sf_dir):
    """Plans as rows of text: as it is, verbose, as JSON, and with the counts of a run."""
    lines = table(spark, sf_dir, "lineitem")
    text = "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag"
    forms = ["EXPLAIN ", "EXPLAIN VERBOSE ", "EXPLAIN (FORMAT JSON) ", "EXPLAIN ANALYZE "]
    made = [pg_sql(spark, f + text, {"lineitem": lines}).select(F.lit(f.strip()).alias("form"), "line", F.col("QUERY PLAN").alias("plan")) for f in forms]
    return made[0].union(made[1]).union(made[2]).union(made[3])


@query("explain_smoke")
def explain_smoke(spark, sf_dir):
    """The formatted plan of a filtered aggregate, a line a row."""
    frame = table(spark, sf_dir, "lineitem").where("l_quantity > 10").groupBy("l_returnflag").count()
    text = frame._jdf.queryExecution().explainString(frame._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "line int, text string")


@query("query_metrics")
def query_metrics(spark, sf_dir):
    """Counters of a run as rows of component, metric and value, collected while the query runs."""
    from pyspark.sql import Observation

    seen = Observation()
    table(spark, sf_dir, "lineitem").where("l_quantity > 10").observe(seen, F.count("*").alias("rows"), F.max("l_orderkey").alias("max_key")).groupBy("l_returnflag").count().collect()
    return spark.createDataFrame([("scan", k, int(v)) for k, v in sorted(seen.get.items())], "component string, metric string, value long")
