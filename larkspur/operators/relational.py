"""DISTINCT ON, grouping sets over empty inputs, row comparison, joins by blank-insensitive and guarded small sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import asc, desc


def distinct_on(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group of keys in the given order."""
    rank = "__lk_first"
    return frame.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def grouping_sets(frame: DataFrame, sets: list[tuple[str, ...]], keys: list[str], aggregates: list[Column]) -> DataFrame:
    """GROUP BY GROUPING SETS; the empty set gives its row even if there are no rows to group.

    The empty set is an aggregate of its own next to one Expand over the others, which share one shuffle.
    """
    some = [s for s in sets if s]
    empty = [s for s in sets if not s]
    parts = []
    if some:
        parts.append(frame.groupingSets([[F.col(c) for c in s] for s in some], *keys).agg(*aggregates))
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    for _ in empty:
        total = frame.agg(*aggregates)
        parts.append(total.select(*(F.lit(None).cast(kinds[k]).alias(k) for k in keys), *total.columns))
    return reduce(DataFrame.unionAll, parts)


def row_less(left: list[Column], right: list[Column], or_equal: bool = False) -> Column:
    """(a, b, ...) < (c, d, ...) by SQL's rule: null if the first unequal pair has a null."""
    out = left[-1] <= right[-1] if or_equal else left[-1] < right[-1]
    for a, b in zip(reversed(left[:-1]), reversed(right[:-1]), strict=True):
        out = (a < b) | ((a == b) & out)
    return out


def row_equal(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, (a == b for a, b in zip(left, right, strict=True)))


def any_of(value: Column, others: list[Column], compare) -> Column:
    """value op ANY (ARRAY[...]): false for an empty list, null if undecided."""
    return reduce(lambda x, y: x | y, (compare(value, o) for o in others), F.lit(False))


def all_of(value: Column, others: list[Column], compare) -> Column:
    return reduce(lambda x, y: x & y, (compare(value, o) for o in others), F.lit(True))


def not_in(frame: DataFrame, value: str, others: DataFrame) -> DataFrame:
    """The rows with value NOT IN others' one column: all if that has no rows, none if it has a null, else those whose value is known and not in it.

    Spark's own join for this sends all others through the driver to every task. Here they meet the rows by key, each
    of them once, and what is sent around is how many they are and how many are null.
    """
    other, rows, known = "__lk_other", "__lk_rows", "__lk_known"
    keys = others.toDF(other)
    counts = keys.agg(F.count("*").alias(rows), F.count(other).alias(known))
    some = frame.join(F.broadcast(counts), (F.col(rows) == 0) | ((F.col(rows) == F.col(known)) & F.col(value).isNotNull()))
    return some.join(keys.distinct(), F.col(value) == F.col(other), "left_anti").drop(rows, known)


def unique_names(frame: DataFrame) -> DataFrame:
    """Output columns of one name get numbers behind it, as results need names of their own."""
    seen: dict[str, int] = {}
    names = []
    for name in frame.columns:
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return frame.toDF(*names)


def limit(frame: DataFrame, rows: int | None = None, offset: int | None = None) -> DataFrame:
    """LIMIT and OFFSET; None is LIMIT NULL or OFFSET NULL, no limit and no offset."""
    if offset:
        frame = frame.offset(offset)
    return frame if rows is None else frame.limit(rows)


def with_ties(frame: DataFrame, keys: list[tuple[str, bool]], rows: int) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES; keys are (column, descending), nulls counting as greatest.

    The n first rows are a top-k; the last of them tells the key whose other rows come too. No global sort is needed.
    """
    if rows <= 0:
        return frame.limit(0)
    order = [desc(k) if down else asc(k) for k, down in keys]
    back = [asc(k, nulls_first=True) if down else desc(k) for k, down in keys]
    top = frame.orderBy(*order).limit(rows)
    last = top.orderBy(*back).limit(1).select(*(F.col(k).alias(f"__lk_{k}") for k, _ in keys))
    tied = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__lk_{k}")) for k, _ in keys))
    return top.join(F.broadcast(last), tied, "left_anti").unionAll(frame.join(F.broadcast(last), tied, "left_semi"))
