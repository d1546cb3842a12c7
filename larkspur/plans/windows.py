"""Window functions and frames."""

from pyspark.sql import functions as F

from ..operators.windows import END, START, filtered_over, over_groups, over_partition, ranking, sum_to_end, window
from ..sources.tables import table
from .registry import query, sql

#: Partitions of orders with ties in the order key.
T = "(SELECT o_orderkey AS k, o_orderstatus AS p, CAST(o_custkey % 40 AS INT) AS v, NULLIF(CAST(o_custkey % 11 AS INT), 4) AS x FROM {orders}) AS t"
TB = T.replace("{orders}", "orders")
BY = "PARTITION BY p ORDER BY v NULLS LAST, k"
TIES = "PARTITION BY p ORDER BY v"


def win(name: str, *made: str) -> None:
    sql(name, f"SELECT k, {', '.join(made)} FROM {T}")


win("row_number", f"CAST(row_number() OVER ({BY}) AS BIGINT) AS r")
win("rank", f"CAST(rank() OVER ({TIES}) AS BIGINT) AS r")
win("dense_rank", f"CAST(dense_rank() OVER ({TIES}) AS BIGINT) AS r")
win("percent_rank", f"round(percent_rank() OVER ({TIES}), 9) AS r")
win("cume_dist", f"round(cume_dist() OVER ({TIES}), 9) AS r")
win("ntile", f"CAST(ntile(7) OVER ({BY}) AS BIGINT) AS r")
win("lag_lead_default", f"lag(v) OVER ({BY}) AS a", f"lag(v, 3) OVER ({BY}) AS b", f"lead(v, 2, -1) OVER ({BY}) AS c")
win("nth_value", f"nth_value(k, 3) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a")
win("win_count_star", "CAST(count(*) OVER (PARTITION BY p) AS BIGINT) AS n", f"CAST(count(x) OVER ({TIES}) AS BIGINT) AS m")
win("win_sum_running", f"CAST(sum(x) OVER ({TIES}) AS BIGINT) AS s")
win("win_avg_sliding", f"round(avg(x) OVER ({BY} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 8) AS a")
win("win_min_max", f"min(x) OVER ({BY} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS lo", "max(x) OVER (PARTITION BY v) AS hi")
win("win_stddev", f"round(stddev_samp(x) OVER ({BY} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS s", "round(var_pop(x) OVER (PARTITION BY v), 6) AS q")
win("win_regr", "round(regr_slope(CAST(x AS DOUBLE), CAST(v AS DOUBLE)) OVER (PARTITION BY p), 6) + 0.0 AS s", "CAST(regr_count(x, v) OVER (PARTITION BY v) AS BIGINT) AS n")
win("win_corr", "round(corr(CAST(x AS DOUBLE), CAST(v AS DOUBLE)) OVER (PARTITION BY p), 6) + 0.0 AS c")
sql("named_window", f"SELECT k, CAST(sum(x) OVER w AS BIGINT) AS s, CAST(count(*) OVER w AS BIGINT) AS n FROM {T} WINDOW w AS ({BY})")
win("frame_rows_past", f"CAST(sum(x) OVER ({BY} ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) AS BIGINT) AS s")
win("frame_rows_future", f"CAST(sum(x) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS BIGINT) AS s")
win("frame_rows_no_order", "CAST(count(*) OVER (PARTITION BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS BIGINT) AS s")
win("frame_range_offset", f"CAST(sum(x) OVER ({TIES} RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s")
sql("win_over_aggregate", "SELECT o_orderstatus AS p, o_orderpriority AS q, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS n, CAST(rank() OVER (ORDER BY count(*) DESC, o_orderstatus, o_orderpriority) AS BIGINT) AS r FROM {orders} GROUP BY o_orderstatus, o_orderpriority")


def _t(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("p"), (F.col("o_custkey") % 40).cast("int").alias("v"), F.nullif((F.col("o_custkey") % 11).cast("int"), F.lit(4)).alias("x"))


@query("first_last_value", f"SELECT k, first_value(k) OVER ({BY}) AS a, last_value(k) OVER ({BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {TB}")
def first_last_value(spark, sf_dir):
    """A frame from the partition's start has its first row, and one to its end has its last, whichever row is current."""
    place = F.struct(F.col("v").isNull(), F.col("v"), F.col("k").isNull(), F.col("k"))
    return over_partition(_t(spark, sf_dir), ["p"], a=F.min_by("k", place), b=F.max_by("k", place)).select("k", "a", "b")


@query("frame_range_unbounded", f"SELECT k, CAST(sum(x) OVER ({TIES} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS s FROM {TB}")
def frame_range_unbounded(spark, sf_dir):
    return sum_to_end(_t(spark, sf_dir), ["p"], "v", "x", "s").select("k", "s")


@query("frame_groups", f"SELECT k, CAST(sum(x) OVER ({TIES} GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, CAST(count(*) OVER ({TIES} GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n FROM {TB}")
def frame_groups(spark, sf_dir):
    return over_groups(_t(spark, sf_dir), ["p"], [F.col("v")], 2, 1, s=F.sum("x"), n=F.count("*")).select("k", "s", "n")


@query("win_filter", f"SELECT k, CAST(count(*) FILTER (WHERE x > 5) OVER (PARTITION BY p) AS BIGINT) AS n, CAST(sum(x) FILTER (WHERE v < 20) OVER ({BY}) AS BIGINT) AS s FROM {TB}")
def win_filter(spark, sf_dir):
    rows = _t(spark, sf_dir)
    return rows.select("k", filtered_over(F.count, F.lit(1), F.col("x") > 5, window(["p"])).alias("n"), filtered_over(F.sum, F.col("x"), F.col("v") < 20, window(["p"], ["v", "k"])).alias("s"))


@query("win_string_agg", "SELECT n_nationkey, string_agg(n_name, ',' ORDER BY n_name) OVER (PARTITION BY n_regionkey) AS s FROM nation")
def win_string_agg(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = F.collect_list("n_name").over(window(["n_regionkey"], rows=(START, END)))
    return nation.select("n_nationkey", F.array_join(F.sort_array(rows), ",").alias("s"))


@query("ranking_without_order")
def ranking_without_order(spark, sf_dir):
    """row_number() OVER (PARTITION BY p): some numbering of each partition."""
    return _t(spark, sf_dir).select("p", F.row_number().over(ranking(["p"])).alias("r"))
