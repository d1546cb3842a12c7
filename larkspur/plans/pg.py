"""Statements in PostgreSQL's dialect, run by `pg_sql` over whole tables; DuckDB answers the same text unless another is given."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence
from decimal import Decimal
from typing import Any

from ..sources.tables import table
from ..sql import pg_sql
from .registry import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def pg(name: str, text: str, oracle: str | None = None, parameters: Sequence[Any] = ()) -> None:
    """Registers a statement as pg_NAME."""

    def run(spark, sf_dir):
        named = set(re.findall(r"\w+", text))
        return pg_sql(spark, text, {t: table(spark, sf_dir, t) for t in TABLES if t in named}, parameters=parameters)

    query(f"pg_{name}", oracle or text)(run)


#: Integers with nulls; prices as numeric(12,2).
N = "(SELECT o_orderkey AS k, NULLIF((o_custkey % 7)::int, 3) AS a, NULLIF((o_orderkey % 5)::int, 2) AS b, o_orderstatus AS s, o_totalprice::numeric(12,2) AS p FROM orders) AS t"

# scans, filters and expressions
pg("project", "SELECT o_orderkey, o_orderstatus AS s, o_totalprice::numeric(12,2) AS p FROM orders")
pg("where", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' OR l_linenumber = 7 AND NOT l_linestatus = 'O'")
pg("no_from", "SELECT 1 AS one, 'it''s' AS t, 2.50 AS d, NULL::int AS n, true AS b")
pg("values", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) AS v(a, b)")
pg("derived", "SELECT q.k, q.n FROM (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) AS q(k, n) WHERE q.n > 10")
pg("cte", "WITH big AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_acctbal > 5000), per(n, m) AS (SELECT n, count(*) FROM big GROUP BY n) SELECT n, m FROM per WHERE m > (SELECT min(m) FROM per)")
pg("row_marks", "SELECT r_regionkey, r_name FROM region FOR UPDATE", "SELECT r_regionkey, r_name FROM region")
pg("comparisons", f"SELECT k, a = b AS e, a <> b AS n, a < b AS l, a >= b AS g, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS i FROM {N}")
pg("three_values", f"SELECT k, a > 2 AND b > 1 AS x, a > 2 OR b > 1 AS y, NOT a > 2 AS z, (a > 2) IS TRUE AS t, (a > 2) IS NOT FALSE AS f, (a > 2) IS UNKNOWN AS u FROM {N}", f"SELECT k, a > 2 AND b > 1 AS x, a > 2 OR b > 1 AS y, NOT a > 2 AS z, (a > 2) IS TRUE AS t, (a > 2) IS NOT FALSE AS f, (a > 2) IS NULL AS u FROM {N}")
pg("between_in", f"SELECT k, a BETWEEN 2 AND 4 AS x, b NOT BETWEEN 1 AND 3 AS y, a IN (1, 2, 6) AS z, a NOT IN (1, NULL) AS w FROM {N}")
pg("any_all", f"SELECT k, a = ANY (ARRAY[1, 4, NULL]) AS x, a <> ALL (ARRAY[1, 2]) AS y, b >= ALL (ARRAY[0, 1]) AS z FROM {N}", f"SELECT k, (a = 1 OR a = 4 OR a = NULL) AS x, (a <> 1 AND a <> 2) AS y, (b >= 0 AND b >= 1) AS z FROM {N}")
pg("rows", f"SELECT k, (a, b) = (1, 4) AS e, (a, b) <> (1, 4) AS n, (a, b) < (4, 3) AS l, (a, b) >= (4, 3) AS g FROM {N}", f"SELECT k, (a = 1 AND b = 4) AS e, (a <> 1 OR b <> 4) AS n, (a < 4 OR (a = 4 AND b < 3)) AS l, (a > 4 OR (a = 4 AND b >= 3)) AS g FROM {N}")
pg("patterns", "SELECT p_partkey, p_name LIKE '%ring%' AS l, p_name NOT LIKE '_e%' AS n, p_type ILIKE 'pro%' AS i, p_brand ~ '^Brand#[12][0-3]$' AS r, p_name !~ 'r.*g' AS x, p_type ~* '^PR' AS c FROM part", "SELECT p_partkey, p_name LIKE '%ring%' AS l, p_name NOT LIKE '_e%' AS n, p_type ILIKE 'pro%' AS i, regexp_matches(p_brand, '^Brand#[12][0-3]$') AS r, NOT regexp_matches(p_name, 'r.*g') AS x, regexp_matches(p_type, '^PR', 'i') AS c FROM part")
pg("case_coalesce_nullif", f"SELECT k, CASE s WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS w, CASE WHEN a > b THEN 1 WHEN a IS NULL THEN 0 ELSE -1 END AS c, COALESCE(a, b, -1) AS d, NULLIF(a, b) AS e FROM {N}")
pg("parameters", "SELECT o_orderkey, o_totalprice::numeric(12,2) - $3 AS d FROM orders WHERE o_orderstatus = $1 AND o_custkey % $2 = 0 AND o_orderdate::date >= $4 AND ($5 OR o_orderkey < 0)", "SELECT o_orderkey, CAST(o_totalprice::numeric(12,2) - 100.25 AS DECIMAL(38,2)) AS d FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0 AND o_orderdate::date >= DATE '1996-01-01'", ["F", 3, Decimal("100.25"), datetime.date(1996, 1, 1), True])

# arithmetic and functions
pg("integer_division", "SELECT l_orderkey, l_linenumber, (l_linenumber - 4) / 3 AS q, (l_linenumber - 4) % 3 AS r, -l_linenumber AS m, l_linenumber * 3 - 5 AS p, -l_orderkey / 7 AS b FROM lineitem", "SELECT l_orderkey, l_linenumber, (l_linenumber - 4) // 3 AS q, (l_linenumber - 4) % 3 AS r, -l_linenumber AS m, l_linenumber * 3 - 5 AS p, -l_orderkey // 7 AS b FROM lineitem")
pg("integer_edges", "SELECT r_regionkey, (9223372036854775807 - r_regionkey) / 9223372036854775806 AS a, (r_regionkey - 9223372036854775807) / 2 AS b, 9223372036854775806 / 9223372036854775807 AS c FROM region", "SELECT r_regionkey, (9223372036854775807 - r_regionkey) // 9223372036854775806 AS a, (r_regionkey - 9223372036854775807) // 2 AS b, CAST(0 AS BIGINT) AS c FROM region")
pg("numerics", f"SELECT k, p + 1.5 AS a, p - 2 AS b, p * 0.25 AS m, p % 7.5 AS r, abs(-p) AS z FROM {N}", f"SELECT k, CAST(p + 1.5 AS DECIMAL(38,2)) AS a, CAST(p - 2 AS DECIMAL(38,2)) AS b, CAST(p * 0.25 AS DECIMAL(38,4)) AS m, CAST(p % 7.5 AS DECIMAL(38,2)) AS r, p AS z FROM {N}")
pg("rounding", f"SELECT k, round(p, 1) AS a, round(p, -2) AS b, trunc(p, 1) AS c, round(p) AS d, ceil(p) AS e, floor(-p) AS f FROM {N}", f"SELECT k, CAST(round(p, 1) AS DECIMAL(38,1)) AS a, CAST(round(p, -2) AS DECIMAL(38,0)) AS b, CAST(trunc(p * 10) / 10 AS DECIMAL(38,1)) AS c, CAST(round(p, 0) AS DECIMAL(38,0)) AS d, CAST(ceil(p) AS DECIMAL(38,0)) AS e, CAST(floor(-p) AS DECIMAL(38,0)) AS f FROM {N}")
pg("floats", "SELECT l_orderkey, l_linenumber, l_quantity + 0.5 AS a, l_quantity - l_linenumber AS b, l_quantity * 2 AS c, l_quantity / 4 AS d, round(l_linenumber::float8 * 0.5) AS e, trunc(l_linenumber::float8 * -0.5) + 0 AS f FROM lineitem", "SELECT l_orderkey, l_linenumber, l_quantity + 0.5 AS a, l_quantity - l_linenumber AS b, l_quantity * 2 AS c, l_quantity / 4 AS d, round_even(l_linenumber * 0.5::DOUBLE, 0) AS e, trunc(l_linenumber * -0.5::DOUBLE) + 0 AS f FROM lineitem")
pg("casts", "SELECT l_orderkey, l_linenumber, l_linenumber::text || '!' AS t, ('1' || l_linenumber)::int + 1 AS i, (l_linenumber * 0.5::float8)::int AS h, (l_linenumber - 3)::bool AS b, l_linenumber::float8 AS d, '2.50'::numeric(6,2) AS n FROM lineitem", "SELECT l_orderkey, l_linenumber, l_linenumber::text || '!' AS t, ('1' || l_linenumber)::int + 1 AS i, CAST(round_even(l_linenumber * 0.5::DOUBLE, 0) AS INT) AS h, l_linenumber <> 3 AS b, l_linenumber::double AS d, '2.50'::decimal(6,2) AS n FROM lineitem")
pg("texts", "SELECT p_partkey, p_name || '-' || p_type AS c, length(p_name) AS n, reverse(p_name) AS r, upper(p_type) AS u, lower(p_brand) AS l, substring(p_brand FROM 2 FOR 3) AS s, replace(p_name, 'e', '3') AS x, concat(p_name, NULL, p_size) AS y, concat_ws('/', p_name, NULL, p_size) AS z, left(p_name, 3) AS a, right(p_name, 2) AS b, strpos(p_name, 'r') AS o, btrim(p_name, 'sg') AS t FROM part", "SELECT p_partkey, p_name || '-' || p_type AS c, CAST(length(p_name) AS INT) AS n, reverse(p_name) AS r, upper(p_type) AS u, lower(p_brand) AS l, substring(p_brand, 2, 3) AS s, replace(p_name, 'e', '3') AS x, concat(p_name, NULL, p_size) AS y, concat_ws('/', p_name, NULL, p_size) AS z, left(p_name, 3) AS a, right(p_name, 2) AS b, CAST(strpos(p_name, 'r') AS INT) AS o, trim(p_name, 'sg') AS t FROM part")
pg("padded", "SELECT p_partkey, p_name::char(6) = 'steel ' AS e, length(p_type::char(12)) AS n, p_name::varchar(4) AS v, p_type::char(9) || '|' AS c FROM part", "SELECT p_partkey, rtrim(substr(p_name, 1, 6)) = 'steel' AS e, CAST(length(rtrim(substr(p_type, 1, 12))) AS INT) AS n, substr(p_name, 1, 4) AS v, rtrim(substr(p_type, 1, 9)) || '|' AS c FROM part")
pg("format", "SELECT p_partkey, format('%s|%-12s|%5s|%%', p_name, p_type, p_size) AS f, quote_literal(p_name) AS q FROM part", "SELECT p_partkey, p_name || '|' || rpad(p_type, CAST(greatest(12, length(p_type)) AS INT), ' ') || '|' || lpad(CAST(p_size AS VARCHAR), 5, ' ') || '|%' AS f, '''' || p_name || '''' AS q FROM part")
pg("arrays", "SELECT n_nationkey, (ARRAY[n_name, 'x', NULL])[n_regionkey] AS a, (ARRAY[5, 6, 7])[2] AS b, (ARRAY[5])[4] AS c FROM nation", "SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN n_name WHEN 2 THEN 'x' END AS a, 6 AS b, CAST(NULL AS INT) AS c FROM nation")
pg("dates", "SELECT o_orderkey, o_orderdate::date - date '1995-01-01' AS d, o_orderdate::date + 10 AS p, o_orderdate::date < date '1996-06-01' AS l, extract(year FROM o_orderdate)::int AS y, (o_orderdate::date + interval '1 month')::date AS m FROM orders", "SELECT o_orderkey, CAST(o_orderdate::date - date '1995-01-01' AS INT) AS d, o_orderdate::date + 10 AS p, o_orderdate::date < date '1996-06-01' AS l, extract(year FROM o_orderdate)::int AS y, (o_orderdate::date + interval '1 month')::date AS m FROM orders")
pg("bytes", "SELECT p_partkey, length(p_name::bytea) AS n, octet_length(('é' || p_name)::bytea) AS m FROM part", "SELECT p_partkey, CAST(octet_length(encode(p_name)) AS INT) AS n, CAST(octet_length(encode('é' || p_name)) AS INT) AS m FROM part")

# joins and subqueries
pg("joins", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000 WHERE c.c_acctbal > 0")
pg("left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'")
pg("right_join", "SELECT r.r_name, n.n_name FROM nation n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > 10")
pg("full_join", "SELECT a.k AS x, b.k AS y FROM (SELECT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey + 50 AS k FROM orders) b ON a.k = b.k")
pg("using_natural", "SELECT k, r_name, n_name, m FROM (SELECT r_regionkey AS k, r_name FROM region) r JOIN (SELECT n_regionkey AS k, n_name FROM nation) n USING (k) NATURAL JOIN (SELECT r_regionkey AS k, r_regionkey * 2 AS m FROM region) x")
pg("theta_cross", "SELECT a.n_nationkey AS x, b.n_nationkey AS y, r_regionkey FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey CROSS JOIN region")
pg("semi_anti", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
pg("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2)")
pg("scalar_subqueries", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(r_name) FROM region) AS m, (SELECT r_name FROM region WHERE r_regionkey = 77) AS z FROM customer")
pg("self_join", "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")

# aggregates
pg("aggregates", "SELECT l_returnflag AS f, count(*) AS n, count(NULLIF(l_linenumber, 3)) AS c, count(DISTINCT l_suppkey) AS d, sum(l_linenumber) AS s, min(l_quantity) AS lo, max(l_linestatus) AS hi FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag AS f, count(*) AS n, count(NULLIF(l_linenumber, 3)) AS c, count(DISTINCT l_suppkey) AS d, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_linestatus) AS hi FROM lineitem GROUP BY l_returnflag")
pg("exact_sums", "SELECT o_orderstatus AS s, sum(o_totalprice::numeric(12,2)) AS p, sum(o_orderkey) AS k FROM orders GROUP BY 1", "SELECT o_orderstatus AS s, CAST(sum(o_totalprice::numeric(12,2)) AS DECIMAL(38,2)) AS p, CAST(sum(o_orderkey) AS DECIMAL(38,0)) AS k FROM orders GROUP BY 1")
pg("exact_averages", "SELECT l_returnflag AS f, avg(l_linenumber) AS a, avg(l_extendedprice::numeric(12,2)) AS b FROM lineitem GROUP BY 1", "SELECT f, CAST(CAST(a16 // 10000000000000000 AS VARCHAR) || '.' || lpad(CAST(a16 % 10000000000000000 AS VARCHAR), 16, '0') AS DECIMAL(38,16)) AS a, CAST(CAST(b16 // 10000000000000000 AS VARCHAR) || '.' || lpad(CAST(b16 % 10000000000000000 AS VARCHAR), 16, '0') AS DECIMAL(38,16)) AS b FROM (SELECT l_returnflag AS f, (2 * sum(l_linenumber)::HUGEINT * 10000000000000000::HUGEINT + count(*)) // (2 * count(*)) AS a16, (2 * sum(CAST(l_extendedprice::numeric(12,2) * 100 AS HUGEINT))::HUGEINT * 100000000000000::HUGEINT + count(*)) // (2 * count(*)) AS b16 FROM lineitem GROUP BY 1) AS t")
pg("filters", "SELECT l_returnflag AS f, count(*) FILTER (WHERE l_quantity > 30) AS n, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 49) AS d, sum(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag AS f, count(*) FILTER (WHERE l_quantity > 30) AS n, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 49) AS d, CAST(sum(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
pg("mixed_distinct", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p, sum(DISTINCT o_custkey % 11) AS m, count(*) AS n, max(o_orderkey) AS k FROM orders GROUP BY 1", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p, CAST(sum(DISTINCT o_custkey % 11) AS DECIMAL(38,0)) AS m, count(*) AS n, max(o_orderkey) AS k FROM orders GROUP BY 1")
pg("statistics", "SELECT l_returnflag AS f, round(stddev(l_quantity)::numeric, 6) AS a, round(var_pop(l_quantity)::numeric, 6) AS b, round(corr(l_quantity, l_linenumber::float8)::numeric, 6) AS c, round(regr_slope(l_quantity, l_linenumber::float8)::numeric, 6) AS d, regr_count(NULLIF(l_quantity, 1), l_linenumber::float8) AS n FROM lineitem GROUP BY 1", "SELECT l_returnflag AS f, CAST(round(stddev(l_quantity), 6) AS DECIMAL(38,6)) AS a, CAST(round(var_pop(l_quantity), 6) AS DECIMAL(38,6)) AS b, CAST(round(corr(l_quantity, l_linenumber::double), 6) AS DECIMAL(38,6)) AS c, CAST(round(regr_slope(l_quantity, l_linenumber::double), 6) AS DECIMAL(38,6)) AS d, CAST(regr_count(NULLIF(l_quantity, 1), l_linenumber::double) AS BIGINT) AS n FROM lineitem GROUP BY 1")
pg("covar_distinct", "SELECT round(covar_pop(DISTINCT l_quantity, l_linenumber::float8)::numeric, 6) AS v FROM lineitem", "SELECT CAST(round(covar_pop(q, k), 6) AS DECIMAL(38,6)) AS v FROM (SELECT DISTINCT l_quantity AS q, l_linenumber::double AS k FROM lineitem) AS t")
pg("having", "SELECT o_custkey % 13 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 13 HAVING count(*) > 5 AND min(o_orderkey) < 100")
pg("global", "SELECT count(*) AS n, max(n_name) AS m, sum(n_nationkey) AS s FROM nation WHERE n_nationkey < 0", "SELECT count(*) AS n, max(n_name) AS m, CAST(sum(n_nationkey) AS DECIMAL(38,0)) AS s FROM nation WHERE n_nationkey < 0")
F = "CASE o_orderkey % 5 WHEN 0 THEN 'NaN'::float8 WHEN 1 THEN 'Infinity'::float8 WHEN 2 THEN 0.0::float8 WHEN 3 THEN -(0.0::float8) END"
pg("float_specials", f"SELECT k = 'NaN'::float8 AS nan, k = 'Infinity'::float8 AS inf, k < 1 AS zero, n FROM (SELECT k, count(*) AS n FROM (SELECT {F} AS k FROM orders) AS t GROUP BY k) AS u")
pg("float_distinct", f"SELECT count(DISTINCT k) AS n, count(k) AS m FROM (SELECT {F} AS k FROM orders) AS t")
pg("float_special_averages", "SELECT s, a = 'NaN'::float8 AS nan, a = 'Infinity'::float8 AS inf, a < 10 AS finite FROM (SELECT s, avg(k) AS a FROM (SELECT o_orderstatus AS s, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 50 = 1 THEN 'Infinity'::float8 WHEN o_orderstatus = 'O' AND o_orderkey % 50 = 2 THEN 'NaN'::float8 ELSE 2.0::float8 END AS k FROM orders) AS t GROUP BY s) AS u")
pg("grouping_sets", "SELECT l_returnflag AS f, l_linestatus AS s, grouping(l_returnflag, l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "SELECT l_returnflag AS f, l_linestatus AS s, CAST(grouping(l_returnflag, l_linestatus) AS INT) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
pg("cube_composite", "SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY CUBE ((l_returnflag, l_linestatus), l_linenumber)", "SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag, l_linestatus), (l_linenumber), ())")
pg("grouping_of_nulls", f"SELECT a, b, grouping(a) AS x, grouping(a, b) AS y, count(*) AS n FROM {N} GROUP BY ROLLUP (a, b)", f"SELECT a, b, CAST(grouping(a) AS INT) AS x, CAST(grouping(a, b) AS INT) AS y, count(*) AS n FROM {N} GROUP BY ROLLUP (a, b)")
pg("grouping_over", "SELECT f, s, g, r FROM (SELECT l_returnflag AS f, l_linestatus AS s, grouping(l_returnflag, l_linestatus) AS g, rank() OVER (PARTITION BY grouping(l_returnflag, l_linestatus) ORDER BY count(*) DESC, l_returnflag, l_linestatus) AS r FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)) AS t", "SELECT f, s, CAST(g AS INT) AS g, rank() OVER (PARTITION BY g ORDER BY n DESC, f NULLS LAST, s NULLS LAST) AS r FROM (SELECT l_returnflag AS f, l_linestatus AS s, grouping(l_returnflag, l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)) AS t")

# windows
W = "PARTITION BY o_custkey ORDER BY o_orderkey"
pg("ranks", f"SELECT o_orderkey, row_number() OVER ({W}) AS a, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS b, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) AS c, ntile(3) OVER ({W}) AS d, percent_rank() OVER ({W}) AS e, cume_dist() OVER ({W}) AS f FROM orders", f"SELECT o_orderkey, row_number() OVER ({W}) AS a, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS b, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) AS c, CAST(ntile(3) OVER ({W}) AS INT) AS d, percent_rank() OVER ({W}) AS e, cume_dist() OVER ({W}) AS f FROM orders")
pg("offsets", f"SELECT o_orderkey, lag(o_orderkey, 2, 0) OVER ({W}) AS a, lead(o_orderstatus) OVER ({W}) AS b, first_value(o_orderkey) OVER ({W}) AS c, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d, nth_value(o_orderkey, 2) OVER ({W}) AS e FROM orders")
pg("frames", f"SELECT o_orderkey, count(*) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a, max(o_orderkey) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS b, count(*) OVER ({W} RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS c, min(o_orderkey) OVER (PARTITION BY o_custkey) AS d FROM orders")
pg("groups_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders")
pg("window_filter", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n FROM orders")
pg("window_named", f"SELECT o_orderkey, count(*) OVER w AS n, max(o_orderkey) OVER w AS m FROM orders WINDOW w AS ({W})")
pg("window_over_groups", "SELECT o_orderstatus AS s, count(*) AS n, max(count(*)) OVER (PARTITION BY 1) AS m FROM orders GROUP BY o_orderstatus")

# order, limits, distinct, sets
pg("order_limit", f"SELECT k, a FROM {N} ORDER BY a DESC, k LIMIT 50 OFFSET 10", f"SELECT k, a FROM {N} ORDER BY a DESC NULLS FIRST, k LIMIT 50 OFFSET 10")
pg("order_nulls", f"SELECT k, a FROM {N} ORDER BY a NULLS FIRST, k DESC LIMIT 40")
pg("fetch_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 20 ROWS ONLY")
pg("fetch_one", "SELECT n_name FROM nation ORDER BY n_name OFFSET 3 ROWS FETCH NEXT ROW ONLY")
pg("with_ties", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC FETCH FIRST 15 ROWS WITH TIES", "SELECT o_orderkey, o_custkey FROM (SELECT *, rank() OVER (ORDER BY o_custkey DESC) AS r FROM orders) AS t WHERE r <= 15")
pg("limit_null", "SELECT r_regionkey FROM region LIMIT NULL OFFSET 0", "SELECT r_regionkey FROM region")
pg("distinct", f"SELECT DISTINCT a, b, s FROM {N}")
pg("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
pg("union", f"SELECT a AS v FROM {N} UNION SELECT b FROM {N} UNION ALL SELECT r_regionkey FROM region", f"SELECT a::BIGINT AS v FROM {N} UNION SELECT b FROM {N} UNION ALL SELECT r_regionkey FROM region")
pg("intersect_except", "SELECT n_nationkey AS v FROM nation EXCEPT SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation")
