"""Functions with expected values of their own: exact numerics, formats, quoting, intervals, casts."""

import random
from decimal import ROUND_DOWN, ROUND_HALF_UP, Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from larkspur.functions import aggregates as agg
from larkspur.functions import arithmetic as m
from larkspur.functions import casts, intervals
from larkspur.functions import text as t
from larkspur.functions.arithmetic import Numeric
from larkspur.functions.ordering import asc, desc
from larkspur.operators import relational as r
from larkspur.operators import windows as w

getcontext().prec = 80


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def pairs(spark):
    random.seed(9)
    made = [(Decimal(random.randint(-10**9, 10**9)).scaleb(-2), Decimal(random.choice([1, -3, 7, 12345, -99999, 10**7])).scaleb(-random.randint(0, 2))) for _ in range(200)]
    return made, spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(made)], "i int, a decimal(15,2), b decimal(15,2)")


@pytest.mark.parametrize("op,scale", [("+", 2), ("-", 2), ("*", 4), ("/", 16), ("%", 2)])
def test_numeric_policy(pairs, op, scale):
    made, frame = pairs
    a, b = Numeric.of(F.col("a"), 15, 2), Numeric.of(F.col("b"), 15, 2)
    out = {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[op]
    got = {x.i: x.v for x in frame.select("i", out.column.alias("v")).collect()}
    assert out.scale == scale
    for i, (x, y) in enumerate(made):
        exact = {"+": x + y, "-": x - y, "*": x * y, "/": x / y, "%": x % y}[op]
        assert got[i] == exact.quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP)


def test_literal_and_integer_scales(spark):
    assert (Numeric.literal("1.250") * Numeric.integer(F.lit(3))).scale == 3
    assert value(spark, (Numeric.literal("1.250") * Numeric.integer(F.lit(3))).column) == Decimal("3.750")
    assert value(spark, (Numeric.literal("1") / Numeric.literal("3")).column) == Decimal("0.3333333333333333")
    with pytest.raises(ValueError):
        Numeric.of(F.lit(1), 38, 20) * Numeric.of(F.lit(1), 38, 19)


def test_avg_is_exact(spark):
    random.seed(2)
    for scale in (0, 2, 6):
        for size in (1, 3, 7, 64):
            rows = [Decimal(random.randint(-10**12, 10**12)).scaleb(-scale) for _ in range(size)]
            frame = spark.createDataFrame([(x,) for x in [*rows, None]], f"x decimal(18,{scale})")
            exact = (sum(rows) / size).quantize(Decimal(1).scaleb(-16), ROUND_HALF_UP)
            assert frame.agg(agg.avg_exact(F.col("x"), scale).alias("a")).first().a == exact
    assert spark.range(0).agg(agg.avg_exact(F.col("id")).alias("a")).first().a is None


@pytest.mark.parametrize("places", [-2, -1, 0, 1, 2])
def test_round_and_trunc(spark, places):
    rows = [Decimal(x) for x in ("0.00", "2.55", "-2.55", "-0.05", "149.99", "-150.00", "99.95", "1234.56", "-1250.00")]
    frame = spark.createDataFrame([(x,) for x in rows], "x decimal(10,2)")
    got = frame.select(F.col("x"), m.round_numeric(F.col("x"), places).alias("r"), m.trunc_numeric(F.col("x"), places).alias("t")).collect()
    for row in got:
        unit = Decimal(1).scaleb(-places)
        assert row.r == (row.x / unit).quantize(Decimal(1), ROUND_HALF_UP) * unit
        assert row.t == (row.x / unit).quantize(Decimal(1), ROUND_DOWN) * unit


def test_integers(spark):
    assert [value(spark, m.int_div(F.lit(a), F.lit(b))) for a, b in ((7, 2), (-7, 2), (7, -2), (-7, -2), (0, 5))] == [3, -3, -3, 3, 0]
    assert value(spark, m.int_div(F.lit(-(2**62)).cast("bigint"), F.lit(3), "bigint")) == -(2**62 // 3)
    for bad in (F.lit(2147483647) + F.lit(1), F.lit(32767).cast("smallint") * F.lit(2).cast("smallint"), F.lit(2**62).cast("bigint") * 4, m.int_div(F.lit(1), F.lit(0))):
        with pytest.raises(Exception, match="OVERFLOW|DIVIDE_BY_ZERO"):
            value(spark, bad)
    assert [value(spark, casts.float_to_int(F.lit(x))) for x in (0.5, 1.5, 2.5, -0.5, -1.5)] == [0, 2, 2, 0, -2]
    assert [value(spark, casts.numeric_to_int(F.lit(Decimal(x)))) for x in ("0.5", "1.5", "-2.5")] == [1, 2, -3]
    assert [value(spark, m.trunc_float(F.lit(x))) for x in (2.7, -2.7)] == [2.0, -2.0]
    for bad in ("NaN", "Infinity", "x"):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            value(spark, casts.text_to_numeric(F.lit(bad)))


FORMATS = [
    ("%s|%s", ["a", None], "a|"),
    ("%%%s", ["x"], "%x"),
    ("%2$s %1$s %s", ["a", "b"], "b a b"),
    ("%I.%I", ["tab", "My col"], 'tab."My col"'),
    ("%I", ['a"b'], '"a""b"'),
    ("%L %L %L", ["it's", None, "a\\b"], "'it''s' NULL E'a\\\\b'"),
    (">>%10s<<", ["Hello"], ">>     Hello<<"),
    (">>%-10s<<", ["Hello"], ">>Hello     <<"),
    (">>%*s<<", ["10", "Hello"], ">>     Hello<<"),
    (">>%*s<<", ["-10", "Hello"], ">>Hello     <<"),
    (">>%2$*1$L<<", ["10", "x"], ">>       'x'<<"),
    (">>%2$*1$L<<", ["-10", None], ">>NULL      <<"),
    (">>%3s<<", ["Hello"], ">>Hello<<"),
    ("plain", [], "plain"),
]


@pytest.mark.parametrize("pattern,args,want", FORMATS)
def test_format(spark, pattern, args, want):
    assert t.format_text(pattern, args) == want
    columns = [F.lit(a).cast("string") for a in args]
    assert value(spark, t.format(pattern, *columns)) == want
    assert value(spark, t.format_dynamic(F.lit(pattern), *columns)) == want


@pytest.mark.parametrize("pattern,args,said", [("%s", [], "too few"), ("%x", ["a"], "unrecognized"), ("%", [], "unterminated"), ("%0$s", ["a"], "argument 0"), ("%3$s", ["a", "b"], "too few")])
def test_format_errors(pattern, args, said):
    with pytest.raises(ValueError, match=said):
        t.format_text(pattern, args)
    with pytest.raises(ValueError, match=said):
        t.format(pattern, *map(F.lit, args))


def test_null_identifier_is_an_error(spark):
    with pytest.raises(Exception, match="SQL identifier"):
        value(spark, t.format("%I", F.lit(None).cast("string")))


def test_text(spark):
    true, none = F.lit(True), F.lit(None).cast("string")
    assert value(spark, t.concat(F.lit("a"), none, true, F.lit(3), booleans=(2,))) == "at3"
    assert value(spark, t.concat_ws("-", F.lit("a"), none, ~true, booleans=(2,))) == "a-f"
    assert value(spark, t.quote_literal(none)) is None
    assert [value(spark, t.bpchar(F.lit(x), 3)) for x in ("a", "abcd")] == ["a  ", "abc"]
    assert value(spark, t.bpchar_length(F.lit("ab  "))) == 2
    assert [value(spark, casts.subscript(F.array(F.lit(5), F.lit(6)), i)) for i in (0, 1, 2, 3, -1)] == [None, 5, 6, None, None]


@pytest.mark.parametrize("fields,want", [((0, 0, 0), "00:00:00"), ((14, 3, 3_723_000_000), "1 year 2 mons 3 days 01:02:03"), ((1, 0, 28_800_000_000), "1 mon 08:00:00"), ((-1, 2, 0), "-1 mons +2 days"), ((0, -1, 1_500_000), "-1 days +00:00:01.5"), ((0, 0, -90_061_000_001), "-25:01:01.000001"), ((-13, 0, 0), "-1 years -1 mons"), ((0, 1, 0), "1 day")])
def test_interval_text(spark, fields, want):
    assert value(spark, intervals.interval_text(intervals.interval(*fields))) == want


def test_interval_avg(spark):
    def avg(*rows):
        frame = spark.createDataFrame([(x,) for x in rows], "i struct<months:bigint,days:bigint,micros:bigint>")
        made = frame.agg(intervals.interval_avg(F.col("i")).alias("a")).first().a
        return None if made is None else tuple(made)

    assert avg((1, 0, 0), (2, 0, 0)) == (1, 15, 0)
    assert avg((0, 1, 0), (0, 2, 0)) == (0, 1, 43_200_000_000)
    assert avg((1, 0, 0), (0, 0, 0), (0, 0, 0)) == (0, 10, 0)
    assert avg((0, 0, 10), (0, 0, 20), None) == (0, 0, 15)
    assert avg((-1, 0, 0), (0, 0, 0)) == (0, -15, 0)
    assert avg(None) is None
    assert spark.range(0).agg(intervals.interval_avg(intervals.interval(1)).alias("a")).first().a is None


def test_orders_and_rows(spark):
    frame = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [x.x for x in frame.orderBy(asc("x")).collect()] == [1, 3, None]
    assert [x.x for x in frame.orderBy(desc("x")).collect()] == [None, 3, 1]
    n = F.lit(None).cast("int")
    assert value(spark, r.row_less([F.lit(1), n], [F.lit(1), F.lit(3)])) is None
    assert value(spark, r.row_less([F.lit(0), n], [F.lit(1), F.lit(3)])) is True
    assert value(spark, r.any_of(F.lit(1), [], lambda a, b: a == b)) is False
    assert value(spark, r.all_of(F.lit(1), [], lambda a, b: a == b)) is True
    same = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("x", "x", "y")
    assert r.unique_names(same).columns == ["x", "x_2", "y"]
    assert [x.x for x in r.with_ties(spark.createDataFrame([(1,), (2,), (2,), (3,)], "x int"), [("x", False)], 2).orderBy("x").collect()] == [1, 2, 2]
    ties = spark.createDataFrame([(None, 1), (3, 2), (None, 3), (1, 4)], "x int, y int")
    assert sorted(x.y for x in r.with_ties(ties, [("x", True)], 1).collect()) == [1, 3]


def test_grouping_sets_over_no_rows(spark):
    none = spark.createDataFrame([], "a int, b string, v int")
    got = r.grouping_sets(none, [("a",), (), ("a", "b"), ()], ["a", "b"], [F.count("*").alias("n"), F.sum("v").alias("s")]).collect()
    assert [tuple(x) for x in got] == [(None, None, 0, None)] * 2


def test_groups_frame_against_plain(spark):
    random.seed(4)
    rows = [(random.randint(0, 2), random.choice([1, 2, 2, 5, None]), i) for i in range(80)]
    frame = spark.createDataFrame(rows, "p int, o int, v int")
    for lo, hi in ((1, 0), (0, 2), (None, 1), (1, None)):
        got = {x.v: x.s for x in w.over_groups(frame, ["p"], [asc("o")], lo, hi, s=F.sum("v")).collect()}
        for p in range(3):
            mine = [x for x in rows if x[0] == p]
            peers = sorted({x[1] for x in mine}, key=lambda o: (o is None, o or 0))
            for x in mine:
                at = peers.index(x[1])
                near = peers[0 if lo is None else max(0, at - lo) : len(peers) if hi is None else at + hi + 1]
                assert got[x[2]] == sum(y[2] for y in mine if y[1] in near)


def test_scalar_subquery_of_two_rows_is_an_error(spark):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        spark.sql("SELECT (SELECT * FROM VALUES (1), (2))").collect()


def test_big_sums(spark):
    frame = spark.createDataFrame([(2**62,)] * 5, "x bigint")
    assert frame.agg(agg.sum_bigint(F.col("x")).alias("s")).first().s == 5 * 2**62
    assert frame.agg(agg.string_agg(F.lit(None).cast("string"), ",").alias("s")).first().s is None


def test_csv(spark, tmp_path):
    from larkspur.sources.tables import copy_to_csv

    copy_to_csv(spark.createDataFrame([(1, None, 'a"b,c', "")], "a int, b string, c string, d string").coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text() == '1,,"a""b,c",""\n'


def test_csv_files_have_the_lines_of_copy(spark, tmp_path):
    from larkspur.sources.tables import copy_to_csv, csv_line

    rows = spark.createDataFrame([(1, True, " a b "), (2, False, 'say "x"'), (3, None, "two\nlines"), (4, True, "semi;colon, comma"), (5, False, None)], "k int, b boolean, t string").coalesce(1)
    copy_to_csv(rows, str(tmp_path / "out"), header=True)
    (part,) = (tmp_path / "out").glob("part-*.csv")
    lines = [r.value for r in rows.select(csv_line(rows).alias("value")).collect()]
    assert part.read_text() == "\n".join(["k,b,t", *lines]) + "\n"
    assert lines[0] == "1,t, a b " and lines[1] == '2,f,"say ""x"""' and lines[4] == "5,f,"


def test_event_stream(spark, tmp_path):
    from larkspur.streaming.events import counts_by_window, event_stream

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = counts_by_window(event_stream(spark, str(tmp_path / "in"), events.schema), "6 hours")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    want = {tuple(x) for x in counts_by_window(events, "6 hours").collect()}
    assert {tuple(x) for x in spark.table("seen").collect()} == want
