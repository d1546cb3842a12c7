"""Scalar functions, operators and casts."""

from pyspark.sql import functions as F

from ..functions import arithmetic as m
from ..functions import casts as c
from ..functions import text as t
from ..functions.arithmetic import Numeric
from ..functions.intervals import interval, interval_text
from ..sources.tables import table
from .registry import query, sql

LINES = "FROM lineitem"
#: A float on both sides of zero with halves, and texts with quotes, blanks and nulls.
X = "(CAST(l_linenumber AS DOUBLE) * 0.5 - 2)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_linenumber").cast("double") * 0.5 - 2)


def lines(name, oracle, **made):
    """Expressions over single lines; `oracle` are the same as SQL, in the same order."""

    def run(spark, sf_dir):
        return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *(value().alias(k) for k, value in made.items()))

    query(name, f"SELECT l_orderkey, l_linenumber, {', '.join(f'{sql} AS {k}' for k, sql in zip(made, oracle, strict=True))} {LINES}")(run)



def K():
    return F.col("l_linenumber")


def Q():
    return F.col("l_quantity")


def P():
    return F.col("l_extendedprice")


def money(name):
    return Numeric.of(F.col(name), 15, 2)



lines("int_add_checked", ["l_linenumber + 5", "l_linenumber - 9", "l_linenumber * 3"], a=lambda: K() + 5, s=lambda: K() - 9, p=lambda: K() * 3)
MOST = 9223372036854775807
lines(
    "int_div_trunc",
    ["CAST(trunc((l_linenumber - 4) / 3) AS INT)", "CAST(trunc(-l_orderkey / 7) AS BIGINT)", f"({MOST} - l_linenumber) // {MOST}", f"(l_linenumber - {MOST}) // 2"],
    a=lambda: m.int_div(K() - 4, F.lit(3)), b=lambda: m.int_div(-F.col("l_orderkey"), F.lit(7), "bigint"), c=lambda: m.int_div(F.lit(MOST) - K(), F.lit(MOST), "bigint"), d=lambda: m.int_div(K() - F.lit(MOST), F.lit(2), "bigint"),
)
lines("modulo_sign", ["(l_linenumber - 4) % 3"], a=lambda: (K() - 4) % 3)
lines("shifts", ["CAST(l_linenumber::BIGINT << 3 AS INT)", "CAST(l_orderkey::BIGINT >> 2 AS BIGINT)"], a=lambda: m.shift_left(K(), 3), b=lambda: m.shift_right(F.col("l_orderkey"), 2, "bigint"))
lines("unary_minus", ["-l_linenumber", "+l_quantity"], a=lambda: -K(), b=lambda: Q())
lines("decimal_scale_add", ["CAST(CAST(l_extendedprice AS DECIMAL(15,2)) + CAST(l_discount AS DECIMAL(15,2)) AS DECIMAL(38,2))"], a=lambda: (money("l_extendedprice") + money("l_discount")).column)
lines("decimal_scale_mul", ["CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(15,2)) AS DECIMAL(38,4))"], a=lambda: (money("l_extendedprice") * money("l_discount")).column)
def digits(made):
    """A numeric of scale 16 as the integer of all its digits."""
    return F.regexp_replace(made.cast("string"), r"\.", "").cast("decimal(38,0)")


def cents(name):
    return f"CAST(CAST({name} AS DECIMAL(15,2)) * 100 AS HUGEINT)"


#: The quotient in units of 10^-16, halves away from zero, in integers.
lines("decimal_scale_div", [f"CAST((2 * {cents('l_extendedprice')} * 10000000000000000 + {cents('l_quantity')}) // (2 * {cents('l_quantity')}) AS DECIMAL(38,0))"], a=lambda: digits((money("l_extendedprice") / money("l_quantity")).column))
lines("decimal_scale_mod", ["CAST(CAST(l_extendedprice AS DECIMAL(15,2)) % CAST(7.5 AS DECIMAL(15,2)) AS DECIMAL(38,2))"], a=lambda: (money("l_extendedprice") % Numeric.of(F.lit("7.5"), 15, 2)).column)
lines("abs", [f"abs({X})", "abs(l_linenumber - 5)"], a=lambda: F.abs("x"), b=lambda: F.abs(K() - 5))
lines("ceil", [f"CAST(ceil({X}) AS BIGINT)"], a=lambda: F.ceil("x").cast("bigint"))
lines("floor", [f"CAST(floor({X}) AS BIGINT)"], a=lambda: F.floor("x").cast("bigint"))
lines("round_numeric", ["CAST(round(CAST(l_linenumber * 0.5 - 2 AS DECIMAL(10,1)), 0) AS DECIMAL(38,0))"], a=lambda: m.round_numeric(F.col("x").cast("decimal(10,1)")))
lines("round_numeric_scale", ["CAST(round(CAST(l_extendedprice AS DECIMAL(15,2)), 1) AS DECIMAL(38,1))", "CAST(round(CAST(l_extendedprice AS DECIMAL(15,2)), -2) AS DECIMAL(38,0))"], a=lambda: m.round_numeric(P().cast("decimal(15,2)"), 1), b=lambda: m.round_numeric(P().cast("decimal(15,2)"), -2))
lines("round_float_even", [f"round_even({X}, 0)"], a=lambda: m.round_float(F.col("x")))
lines("trunc_numeric", ["CAST(trunc(l_linenumber * 0.5 - 2) AS DECIMAL(38,0))"], a=lambda: m.trunc_numeric(F.col("x").cast("decimal(10,1)")))
lines("trunc_numeric_scale", ["CAST(trunc(CAST(l_extendedprice AS DECIMAL(15,2)) * 10) / 10 AS DECIMAL(38,1))", "CAST(trunc(CAST(l_extendedprice AS DECIMAL(15,2)) / 100) * 100 AS DECIMAL(38,0))"], a=lambda: m.trunc_numeric(P().cast("decimal(15,2)"), 1), b=lambda: m.trunc_numeric(P().cast("decimal(15,2)"), -2))
lines("trunc_float", [f"trunc({X})"], a=lambda: m.trunc_float(F.col("x")))
lines("hyperbolic_six", [f"round({f}, 9) + 0.0" for f in (f"sinh({X})", f"cosh({X})", f"tanh({X})", f"asinh({X})", f"acosh(abs({X}) + 1)", f"atanh({X} / 9)")], a=lambda: F.round(F.sinh("x"), 9) + 0.0, b=lambda: F.round(F.cosh("x"), 9) + 0.0, d=lambda: F.round(F.tanh("x"), 9) + 0.0, e=lambda: F.round(F.asinh("x"), 9) + 0.0, g=lambda: F.round(F.acosh(F.abs("x") + 1), 9) + 0.0, h=lambda: F.round(F.atanh(F.col("x") / 9), 9) + 0.0)
lines("exp_ln_sqrt", [f"round(exp({X}), 9)", "round(ln(l_quantity), 9)", "round(sqrt(l_quantity), 9)"], a=lambda: F.round(F.exp("x"), 9), b=lambda: F.round(F.ln(Q()), 9), d=lambda: F.round(F.sqrt(Q()), 9))
lines("power", [f"round(power(l_quantity, {X}), 9)"], a=lambda: F.round(F.pow(Q(), F.col("x")), 9))
lines("int_to_bool", ["(l_linenumber - 3) <> 0"], a=lambda: c.int_to_bool(K() - 3))
lines("float_to_int", [f"CAST(round_even({X}, 0) AS INT)"], a=lambda: c.float_to_int(F.col("x")))
lines("text_casts", ["CAST(CAST(l_linenumber AS VARCHAR) AS INT) + 1", "CAST('12.50' AS DECIMAL(6,2))", "CAST(l_orderkey AS VARCHAR)"], a=lambda: K().cast("string").cast("int") + 1, b=lambda: F.lit("12.50").cast("decimal(6,2)"), d=lambda: F.col("l_orderkey").cast("string"))

S = "(SELECT p_partkey AS k, p_name AS n, NULLIF(p_type, 'SMALL') AS y, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size > 20 END AS f, p_name || '''' || CASE WHEN p_partkey % 2 = 0 THEN chr(92) ELSE '' END || '  ' AS q FROM part) AS s"


def _parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.select(k.alias("k"), F.col("p_name").alias("n"), F.nullif("p_type", F.lit("SMALL")).alias("y"), F.when(k % 3 != 0, F.col("p_size") > 20).alias("f"), F.concat("p_name", F.lit("'"), F.when(k % 2 == 0, "\\").otherwise(""), F.lit("  ")).alias("q"))


def parts(name, oracle, **made):
    def run(spark, sf_dir):
        return _parts(spark, sf_dir).select("k", *(value().alias(k) for k, value in made.items()))

    query(name, None if oracle is None else f"SELECT k, {', '.join(f'{sql} AS {k}' for k, sql in zip(made, oracle, strict=True))} FROM {S}")(run)


TF = "CASE WHEN f THEN 't' WHEN NOT f THEN 'f' END"
parts("concat_op", ["n || '-' || y"], a=lambda: F.concat("n", F.lit("-"), "y"))
parts("concat_null_skip", [f"concat(n, y, k, {TF})"], a=lambda: t.concat(F.col("n"), F.col("y"), F.col("k"), F.col("f"), booleans=(3,)))
parts("concat_ws", [f"concat_ws(', ', n, y, k, {TF})"], a=lambda: t.concat_ws(", ", F.col("n"), F.col("y"), F.col("k"), F.col("f"), booleans=(3,)))
parts("bool_text", [TF], a=lambda: t.bool_text(F.col("f")))
parts("length_text", ["CAST(length(q) AS BIGINT)", "CAST(length('é' || n) AS BIGINT)"], a=lambda: F.char_length("q").cast("bigint"), b=lambda: F.char_length(F.concat(F.lit("é"), "n")).cast("bigint"))
parts("length_bpchar", ["CAST(length(rtrim(n)) AS BIGINT)"], a=lambda: t.bpchar_length(t.bpchar(F.col("n"), 20)).cast("bigint"))
parts("reverse", ["reverse(q)"], a=lambda: F.reverse("q"))
parts("format_basic", ["'<' || n || '|' || coalesce(y, '') || '%>'"], a=lambda: t.format("<%s|%s%%>", F.col("n"), F.col("y")))
parts("format_positions_widths", ["lpad(n, CAST(greatest(14, length(n)) AS INT), ' ') || '/' || rpad(coalesce(y, ''), CAST(greatest(10, length(coalesce(y, ''))) AS INT), ' ') || '/' || n"], a=lambda: t.format("%14s/%2$-10s/%1$s", F.col("n"), F.col("y")))
parts("format_identifier_literal", ["CASE WHEN regexp_full_match(n, '[_a-z][_a-z0-9]*') THEN n ELSE '\"' || n || '\"' END || '=' || coalesce('''' || y || '''', 'NULL')"], a=lambda: t.format("%I=%L", F.col("n"), F.col("y")))
parts("quote_literal", ["CASE WHEN contains(q, chr(92)) THEN 'E' ELSE '' END || '''' || replace(replace(q, chr(92), chr(92) || chr(92)), '''', '''''') || ''''"], a=lambda: t.quote_literal(F.col("q")))
parts("varchar_cast", ["substr(n, 1, 5)"], a=lambda: t.varchar(F.col("n"), 5))
parts("bpchar_cast", ["rpad(substr(n, 1, 9), 9, ' ')"], a=lambda: t.bpchar(F.col("n"), 9))
parts("bpchar_equality", ["rtrim(substr(n, 1, 4)) = rtrim(substr(n, 1, 5))"], a=lambda: t.bpchar_key(t.bpchar(F.substring("n", 1, 4), 8)) == t.bpchar_key(t.varchar(F.col("n"), 5)))
parts("array_subscript", ["CASE k % 3 WHEN 0 THEN n WHEN 1 THEN y ELSE 'z' END"], a=lambda: c.subscript(F.array("n", "y", F.lit("z")), F.col("k").cast("int") % 3 + 1))
parts("array_subscript_oob", ["CASE WHEN k % 4 - 1 = 1 THEN n WHEN k % 4 - 1 = 2 THEN y END"], a=lambda: c.subscript(F.array("n", "y"), F.col("k").cast("int") % 4 - 1))


@query("format_dynamic", f"SELECT k, CASE WHEN k % 2 = 0 THEN n || '!' || coalesce(y, '') ELSE coalesce(y, '') || n END AS a FROM {S}")
def format_dynamic(spark, sf_dir):
    """A pattern per row."""
    return _parts(spark, sf_dir).select("k", t.format_dynamic(F.when(F.col("k") % 2 == 0, "%s!%s").otherwise("%2$s%1$s"), F.col("n"), F.col("y")).alias("a"))


@query("random")
def random(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.rand(7).alias("r"))


@query("power_special", "SELECT CAST(i AS INT) AS i, CAST(v AS VARCHAR) AS v FROM (VALUES (1, '1.0'), (2, 'NaN'), (3, '1.0'), (4, 'Infinity'), (5, '0.0'), (6, '1.0')) AS t(i, v)")
def power_special(spark, sf_dir):
    """Powers with NaN and infinities: anything to 0 is 1, and 1 to anything is 1."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    power = lambda x, y: F.when((y == 0) | (x == 1), F.lit(1.0)).otherwise(F.pow(x, y))
    cases = [power(nan, F.lit(0.0)), power(nan, F.lit(2.0)), power(F.lit(1.0), nan), power(inf, F.lit(2.0)), power(F.lit(0.5), inf), power(F.lit(1.0), inf)]
    rows = F.array(*(F.struct(F.lit(i + 1).alias("i"), x.cast("string").alias("v")) for i, x in enumerate(cases)))
    return spark.range(1).select(F.inline(rows))


PLURAL = "CASE WHEN {0} = 1 THEN '' ELSE 's' END"
PLUS = "CASE WHEN {0} AND {1} > 0 THEN '+' ELSE '' END"
#: The text of m months, d days and u microseconds, a field after the other.
INTERVAL_TEXT = f"""SELECT o_orderkey, concat_ws(' ', CASE WHEN m // 12 <> 0 THEN (m // 12) || ' year' || {PLURAL.format('m // 12')} END,
CASE WHEN m % 12 <> 0 THEN (m % 12) || ' mon' || {PLURAL.format('m % 12')} END, CASE WHEN d <> 0 THEN {PLUS.format('m < 0', 'd')} || d || ' day' || {PLURAL.format('d')} END,
CASE WHEN u <> 0 OR m = 0 AND d = 0 THEN CASE WHEN u < 0 THEN '-' WHEN CASE WHEN d <> 0 THEN d < 0 ELSE m < 0 END THEN '+' ELSE '' END || CASE WHEN h < 10 THEN '0' ELSE '' END || h || ':' || lpad(CAST(abs(u) // 60000000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(u) // 1000000 % 60 AS VARCHAR), 2, '0')
|| CASE WHEN abs(u) % 1000000 > 0 THEN '.' || rtrim(lpad(CAST(abs(u) % 1000000 AS VARCHAR), 6, '0'), '0') ELSE '' END END) AS t
FROM (SELECT *, abs(u) // 3600000000 AS h FROM (SELECT o_orderkey, o_orderkey % 27 - 13 AS m, o_orderkey % 5 - 2 AS d, (o_orderkey - 100) * 37123456 AS u FROM orders)) AS i"""


@query("interval_to_text", INTERVAL_TEXT)
def interval_to_text(spark, sf_dir):
    """Texts of intervals of either sign."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return orders.select(k, interval_text(interval(k % 27 - 13, k % 5 - 2, (k - 100) * 37_123_456)).alias("t"))


sql("date_compare", "SELECT o_orderkey FROM {orders} WHERE CAST(o_orderdate AS DATE) < DATE '1995-02-10'")
sql("date_diff", "SELECT o_orderkey, CAST(datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS INT) AS d FROM {orders}", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INT) AS d FROM orders")
sql("time_compare", "SELECT event_id FROM {events} WHERE date_format(ts, 'HH:mm:ss') < '02:30:00'", "SELECT event_id FROM events WHERE CAST(ts AS TIME) < TIME '02:30:00'")
