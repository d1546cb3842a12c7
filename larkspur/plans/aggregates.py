"""Aggregates and grouping."""

from pyspark.sql import functions as F

from ..functions.aggregates import avg_exact, grouping_mask, string_agg, sum_bigint, sum_float4, sum_int
from ..functions.intervals import interval, interval_avg
from ..operators.relational import grouping_sets
from ..sources.tables import table
from .registry import query, sql

G = "FROM {lineitem} GROUP BY l_returnflag"
D2 = "DECIMAL(18,2)"

sql("count_star", f"SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n {G}")
sql("count_expr", "SELECT CAST(count(NULLIF(l_linenumber, 3)) AS BIGINT) AS n, CAST(count(l_orderkey) AS BIGINT) AS m FROM {lineitem}")
sql("count_distinct", f"SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n {G}")
sql("sum_decimal", f"SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS {D2})) AS DECIMAL(28,2)) AS s {G}")
sql("sum_distinct", f"SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s {G}")
sql("avg_float", f"SELECT l_returnflag, round(avg(l_quantity), 6) AS a {G}")
sql("min_max", f"SELECT l_returnflag, min(l_quantity) AS lo, max(l_extendedprice) AS hi, CAST(min(l_shipdate) AS DATE) AS first, min(l_linestatus) AS t {G}")
for _name in ("stddev_pop", "stddev_samp", "var_pop", "var_samp"):
    sql(_name, f"SELECT l_returnflag, round({_name}(l_quantity), 6) AS v {G}")
for _name in ("covar_pop", "covar_samp", "corr", "regr_sxx", "regr_syy", "regr_sxy", "regr_avgx", "regr_avgy", "regr_r2", "regr_slope", "regr_intercept"):
    # quantity over line number: sums stay small, so that rounding hides the order of addition
    sql(_name, f"SELECT l_returnflag, round({_name}(l_quantity, CAST(l_linenumber AS DOUBLE)), 4) + 0.0 AS v {G}")
sql("regr_count", f"SELECT l_returnflag, CAST(regr_count(NULLIF(l_quantity, 1), CAST(l_linenumber AS DOUBLE)) AS BIGINT) AS v {G}")
sql("statistics_of_distinct", "SELECT round(stddev_pop(DISTINCT l_quantity), 6) AS s, round(avg(DISTINCT l_quantity), 6) AS a FROM {lineitem}")
sql("agg_filter", f"SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_quantity > 30) AS BIGINT) AS n, CAST(sum(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS s {G}")
sql("agg_distinct_filter", f"SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 49) AS BIGINT) AS n {G}")
sql("group_by_expr", "SELECT l_linenumber % 3 AS k, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY l_linenumber % 3")
sql("group_by_no_agg", "SELECT o_orderstatus, o_orderpriority FROM {orders} GROUP BY o_orderstatus, o_orderpriority")
sql("having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15")
sql("global_aggregate_empty", "SELECT CAST(count(*) AS BIGINT) AS n, max(n_name) AS m FROM {nation} WHERE n_nationkey < 0")

SETS = "SELECT l_returnflag AS f, l_linestatus AS s, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY "
sql("grouping_sets", SETS + "GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
sql("grouping_sets_nested", SETS + "GROUPING SETS (GROUPING SETS ((l_returnflag), (l_linestatus)), (l_returnflag, l_linestatus))")
sql("rollup", SETS + "ROLLUP (l_returnflag, l_linestatus)")
sql("rollup_composite", "SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber AS k, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY ROLLUP ((l_returnflag, l_linestatus), l_linenumber)")
sql("cube", SETS + "CUBE (l_returnflag, l_linestatus)")
sql("rollup_x_cube", SETS + "ROLLUP (l_returnflag), CUBE (l_linestatus)")
sql("grouping_one_arg", "SELECT l_returnflag AS f, CAST(grouping(l_returnflag) AS INT) AS g, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag)")


@query("sum_int", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
def sum_of_int(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(sum_int(F.col("l_linenumber")).alias("s"))


@query("sum_bigint_decimal", "SELECT l_returnflag, CAST(sum(CAST(l_orderkey AS HUGEINT) * 90000000000000) AS DECIMAL(38,0)) AS s FROM lineitem GROUP BY l_returnflag")
def sum_bigint_decimal(spark, sf_dir):
    """A sum that 64 bits do not hold. Nor do they hold its terms, so the factor, which they have in common, comes to the numeric sum."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((sum_bigint(F.col("l_orderkey")) * 90000000000000).cast("decimal(38,0)").alias("s"))


@query("sum_float", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DOUBLE)) AS FLOAT) AS s FROM lineitem GROUP BY l_returnflag")
def sum_float(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(sum_float4(F.col("l_quantity")).alias("s"))


def digits(made):
    """A numeric of scale 16 as the integer of all its digits."""
    return F.regexp_replace(made.cast("string"), r"\.", "").cast("decimal(38,0)")


def average(total, n, scale=0):
    """SQL of an average in units of 10^-16, halves away from zero, from a sum in units of 10^-scale, in integers."""
    return f"CAST((2 * {total} * CAST({10 ** (16 - scale)} AS HUGEINT) + {n}) // (2 * {n}) AS DECIMAL(38,0))"


@query("avg_int_exact", f"SELECT l_returnflag, {average('CAST(sum(l_linenumber) AS HUGEINT)', 'count(*)')} AS a FROM lineitem GROUP BY l_returnflag")
def avg_int_exact(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(avg_exact(F.col("l_linenumber")).alias("a"))
    return made.select("l_returnflag", digits(F.col("a")).alias("a"))


@query("avg_decimal_exact", f"SELECT l_returnflag, {average('CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS HUGEINT)) AS HUGEINT)', 'count(*)', 2)} AS a FROM lineitem GROUP BY l_returnflag")
def avg_decimal_exact(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(avg_exact(F.col("l_extendedprice"), 2).alias("a"))
    return made.select("l_returnflag", digits(F.col("a")).alias("a"))


@query("avg_distinct", f"SELECT l_returnflag, {average('CAST(sum(DISTINCT l_linenumber) AS HUGEINT)', 'count(DISTINCT l_linenumber)')} AS a FROM lineitem GROUP BY l_returnflag")
def avg_distinct(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(avg_exact(F.col("l_linenumber"), distinct=True).alias("a"))
    return made.select("l_returnflag", digits(F.col("a")).alias("a"))


#: Sums of months, days and microseconds over n; what is left of months becomes days (30 a month), what is left of days becomes time.
AVG_INTERVAL = """WITH s AS (SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey % 5) AS DOUBLE) AS m, CAST(sum(o_custkey % 9) AS DOUBLE) AS d, CAST(sum(o_orderkey * 1000) AS DOUBLE) AS u FROM orders GROUP BY o_orderstatus),
p AS (SELECT *, round((m / n - trunc(m / n)) * 30, 6) AS more FROM s), q AS (SELECT *, round((d / n - trunc(d / n) + more - trunc(more)) * 86400, 6) AS secs FROM p)
SELECT o_orderstatus, CAST(trunc(m / n) AS BIGINT) AS months, CAST(trunc(d / n) + trunc(more) + trunc(secs / 86400) AS BIGINT) AS days, CAST(round_even(u / n + (secs - trunc(secs / 86400) * 86400) * 1000000, 0) AS BIGINT) AS micros FROM q"""


@query("avg_interval", AVG_INTERVAL)
def avg_interval(spark, sf_dir):
    """The average of intervals of months, days and time, by status."""
    orders = table(spark, sf_dir, "orders")
    made = interval((F.col("o_orderkey") % 5), (F.col("o_custkey") % 9), F.col("o_orderkey") * 1000)
    return orders.select("o_orderstatus", made.alias("i")).groupBy("o_orderstatus").agg(interval_avg(F.col("i")).alias("a")).select("o_orderstatus", "a.*")


@query("string_agg_ordered", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS s FROM nation GROUP BY n_regionkey")
def string_agg_ordered(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(string_agg(F.col("n_name"), ",", -F.col("n_nationkey")).alias("s"))


@query("string_agg_distinct", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS s FROM orders GROUP BY o_orderstatus")
def string_agg_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(string_agg(F.col("o_orderpriority"), "|", distinct=True).alias("s"))


@query("grouping_sets_empty_input", "SELECT n_regionkey AS k, CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_nationkey < 0 GROUP BY GROUPING SETS ((), (n_regionkey))")
def grouping_sets_empty_input(spark, sf_dir):
    none = table(spark, sf_dir, "nation").where("n_nationkey < 0").select(F.col("n_regionkey").alias("k"))
    return grouping_sets(none, [(), ("k",)], ["k"], [F.count("*").alias("n")])


@query("grouping_mask", "SELECT l_returnflag AS f, l_linestatus AS s, CAST(grouping(l_returnflag, l_linestatus) AS INT) AS g, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_mask_of_two(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))
    return lines.cube("f", "s").agg(grouping_mask("f", "s").alias("g"), F.count("*").alias("n"))
