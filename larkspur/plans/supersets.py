"""Beyond the strict subset: set operations, recursion, laterals, dates, events by time."""

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming.events import counts_by_window
from .registry import query, sql

sql("intersect", "SELECT n_regionkey AS k FROM {nation} INTERSECT SELECT n_nationkey FROM {nation}")
sql("except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT r_regionkey FROM {region}")
sql("intersect_all", "SELECT n_regionkey AS k FROM {nation} INTERSECT ALL SELECT n_regionkey FROM {nation} WHERE n_nationkey < 9")
sql("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
sql("lateral", "SELECT r_regionkey, m FROM {region}, LATERAL (SELECT max(n_nationkey) AS m FROM {nation} WHERE n_regionkey = r_regionkey) AS l")
sql("extract_year", "SELECT CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY 1")
sql("date_plus_interval", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL '3' MONTH AS DATE) AS d FROM {orders}")
sql("substring", "SELECT DISTINCT substring(o_orderpriority FROM 1 FOR 3) AS s FROM {orders}")


@query("events_tumbling_window", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def events_tumbling_window(spark, sf_dir):
    made = counts_by_window(table(spark, sf_dir, "events"), "1 hour")
    return made.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("events_session_window", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def events_session_window(spark, sf_dir):
    made = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"))
    return made.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
