"""Intervals of months, days and microseconds: sums, averages and their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def interval(months: Column | int = 0, days: Column | int = 0, micros: Column | int = 0) -> Column:
    """An interval as a struct of three fields that are not carried into each other."""
    part = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("bigint")
    return F.struct(part(months).alias("months"), part(days).alias("days"), part(micros).alias("micros"))


def interval_sum(x: Column) -> Column:
    """Sum by field; null if there is no interval."""
    n = F.count(x)
    return F.when(n > 0, interval(F.sum(x["months"]), F.sum(x["days"]), F.sum(x["micros"])))


def interval_avg(x: Column) -> Column:
    """Average: what is left of months becomes days (30 a month), what is left of days becomes time."""
    n = F.count(x)
    months, days, micros = F.sum(x["months"]), F.sum(x["days"]), F.sum(x["micros"])
    toward_zero = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("bigint")
    whole_months = toward_zero(months / n)
    more_days = F.round((months / n - whole_months) * 30, 6)
    whole_days = toward_zero(days / n)
    seconds = F.round((days / n - whole_days + more_days - toward_zero(more_days)) * 86_400, 6)
    carried = toward_zero(seconds / 86_400)
    left = seconds - carried * 86_400
    return F.when(n > 0, interval(whole_months, whole_days + toward_zero(more_days) + carried, F.rint(micros / n + left * 1_000_000)))


def interval_text(x: Column) -> Column:
    """PostgreSQL's text: 1 year 2 mons 3 days 04:05:06; a positive field after a negative one has a plus."""
    months, days, micros = x["months"], x["days"], x["micros"]
    years = F.when(months < 0, F.ceil(months / 12)).otherwise(F.floor(months / 12)).cast("bigint")
    rest = months - years * 12
    size = F.abs(micros)
    fields, negative = [], F.lit(False)
    for value, name in ((years, "year"), (rest, "mon"), (days, "day")):
        text = F.concat(F.when(negative & (value > 0), "+").otherwise(""), value.cast("string"), F.lit(f" {name}"), F.when(value == 1, "").otherwise("s"))
        fields.append(F.when(value != 0, text))
        negative = F.when(value != 0, value < 0).otherwise(negative)
    hours, minutes, seconds, fraction = F.floor(size / 3_600_000_000), F.floor(size / 60_000_000) % 60, F.floor(size / 1_000_000) % 60, size % 1_000_000
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    clock = F.concat(
        F.when(micros < 0, "-").when(negative, "+").otherwise(""),
        F.lpad(hours.cast("string"), F.greatest(F.lit(2), F.length(hours.cast("string"))), F.lit("0")), F.lit(":"), two(minutes), F.lit(":"), two(seconds),
        F.when(fraction > 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(fraction.cast("string"), 6, "0"), "0+$", ""))).otherwise(""),
    )
    date_part = (months != 0) | (days != 0)
    return F.when(x.isNotNull(), F.concat_ws(" ", *fields, F.when((micros != 0) | ~date_part, clock)))
