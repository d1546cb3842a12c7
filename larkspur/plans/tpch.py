"""TPC-H-shaped queries on the tables at hand; columns that these lack are replaced or left out."""

from ..sources.tables import bare
from .registry import sql

PRICE = "CAST(l_extendedprice AS DECIMAL(15,2))"
NET = f"{PRICE} * (1 - CAST(l_discount AS DECIMAL(15,2)))"
REVENUE = f"CAST(sum({NET}) AS DECIMAL(38,4)) AS revenue"

sql("tpch_q01", f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS sum_qty, CAST(sum({PRICE}) AS DECIMAL(38,2)) AS sum_base_price,
CAST(sum({NET}) AS DECIMAL(38,4)) AS sum_disc_price, CAST(sum(CAST({NET} AS DECIMAL(25,4)) * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS DECIMAL(38,6)) AS sum_charge,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, CAST(count(*) AS BIGINT) AS count_order
FROM {{lineitem}} WHERE l_shipdate <= DATE '2001-08-01' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
sql("tpch_q03", f"""SELECT l_orderkey, {REVENUE}, CAST(o_orderdate AS DATE) AS o_orderdate FROM {{customer}}, {{orders}}, {{lineitem}}
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
sql("tpch_q04", """SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS order_count FROM {orders} WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
AND EXISTS (SELECT * FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority""")
sql("tpch_q05", f"""SELECT n_name, {REVENUE} FROM {{customer}}, {{orders}}, {{lineitem}}, {{supplier}}, {{nation}}, {{region}}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name""")
Q06 = f"""SELECT CAST(sum({PRICE} * CAST(l_discount AS DECIMAL(15,2))) AS DECIMAL(38,4)) AS revenue FROM {{lineitem}}
WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND CAST(l_discount AS DECIMAL(15,2)) BETWEEN 0.05 AND 0.07 AND l_quantity < 24"""
# the wider bounds on the column as it is stored reach the scan
sql("tpch_q06", f"{Q06} AND l_discount BETWEEN 0.044D AND 0.076D", bare(Q06))
sql("tpch_q07", f"""SELECT supp_nation, cust_nation, l_year, CAST(sum(volume) AS DECIMAL(38,4)) AS revenue FROM (
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS INT) AS l_year, {NET} AS volume
FROM {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} AS n1, {{nation}} AS n2
WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
AND n1.n_nationkey < 8 AND n2.n_nationkey >= 17 AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') AS shipping GROUP BY supp_nation, cust_nation, l_year""")
sql("tpch_q08", f"""SELECT o_year, round(CAST(sum(CASE WHEN nation = 'NATION_7' THEN volume ELSE 0 END) AS DOUBLE) / CAST(sum(volume) AS DOUBLE), 8) AS mkt_share FROM (
SELECT CAST(extract(YEAR FROM o_orderdate) AS INT) AS o_year, {NET} AS volume, n2.n_name AS nation
FROM {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} AS n1, {{nation}} AS n2, {{region}}
WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey
AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') AS all_nations GROUP BY o_year""")
sql("tpch_q10", f"""SELECT c_custkey, c_name, {REVENUE}, c_acctbal, n_name FROM {{customer}}, {{orders}}, {{lineitem}}, {{nation}}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
sql("tpch_q12", """SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low
FROM {orders}, {lineitem} WHERE o_orderkey = l_orderkey AND l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY l_returnflag""")
sql("tpch_q13", """SELECT c_count, CAST(count(*) AS BIGINT) AS custdist FROM (SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS c_count
FROM {customer} LEFT OUTER JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) AS c_orders GROUP BY c_count""")
sql("tpch_q14", f"""SELECT round(100.00 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {NET} ELSE 0 END) AS DOUBLE) / CAST(sum({NET}) AS DOUBLE), 8) AS promo_revenue
FROM {{lineitem}}, {{part}} WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""")
sql("tpch_q15", f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, CAST(sum({NET}) AS DECIMAL(38,4)) AS total_revenue FROM {{lineitem}}
WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM {{supplier}}, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)""")
sql("tpch_q17", f"""SELECT CAST(sum({PRICE}) AS DECIMAL(38,2)) AS total FROM {{lineitem}}, {{part}} WHERE p_partkey = l_partkey AND p_brand = 'Brand#3'
AND l_quantity < (SELECT 0.6 * avg(l_quantity) FROM {{lineitem}} WHERE l_partkey = p_partkey)""")
sql("tpch_q18", """SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM {customer}, {orders}, {lineitem}
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 250) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
sql("tpch_q19", f"""SELECT {REVENUE} FROM {{lineitem}}, {{part}} WHERE p_partkey = l_partkey AND
((p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 25) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 40) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 40 AND p_size BETWEEN 1 AND 45))""")
Q21 = """SELECT s_name, CAST(count(*) AS BIGINT) AS numwait FROM {supplier}, {lineitem} AS l1, {orders}, {nation}
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate
AND EXISTS (SELECT * FROM {lineitem} AS l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT * FROM {lineitem} AS l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > DATE '2000-06-01')
AND s_nationkey = n_nationkey AND n_regionkey = 2 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100"""
# what the subqueries ask of an order's other lines, from one scan and one exchange of lines: its least and greatest suppliers, of all lines and of the late ones
sql("tpch_q21", """SELECT s_name, CAST(count(*) AS BIGINT) AS numwait FROM {supplier}, {orders}, {nation}, (SELECT l_orderkey, l_suppkey, l_shipdate, min(l_suppkey) OVER w AS a, max(l_suppkey) OVER w AS b,
min(CASE WHEN l_shipdate > DATE '2000-06-01' THEN l_suppkey END) OVER w AS c, max(CASE WHEN l_shipdate > DATE '2000-06-01' THEN l_suppkey END) OVER w AS d FROM {lineitem} WINDOW w AS (PARTITION BY l_orderkey)) AS l1
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate AND (a <> l_suppkey OR b <> l_suppkey) AND (c IS NULL OR c = l_suppkey AND d = l_suppkey)
AND s_nationkey = n_nationkey AND n_regionkey = 2 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""", bare(Q21))
sql("tpch_q22", """SELECT c_nationkey, CAST(count(*) AS BIGINT) AS numcust, CAST(sum(CAST(c_acctbal AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS totacctbal FROM {customer}
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_nationkey""")
