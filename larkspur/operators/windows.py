"""Windows: frames by rows, ranges and groups, filters, and ranking without an order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

START, END, HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


def window(partition: list = (), order: list = (), rows: tuple | None = None, between: tuple | None = None) -> WindowSpec:
    """A window; `rows` is a ROWS frame and `between` a RANGE frame, each (from, to) with negative numbers preceding.

    Without a frame: up to the current row's peers if there is an order, else the whole partition.
    """
    spec = Window.partitionBy(*partition)
    if order:
        spec = spec.orderBy(*order)
    if rows is not None:
        spec = spec.rowsBetween(*rows)
    if between is not None:
        spec = spec.rangeBetween(*between)
    return spec


def ranking(partition: list = (), order: list = ()) -> WindowSpec:
    """A window for ranking and offset functions, which need an order: any, if the query gives none."""
    return window(partition, order or [F.lit(1)])


def over_groups(frame: DataFrame, partition: list, order: list, preceding: int | None, following: int | None, **made) -> DataFrame:
    """Aggregates over GROUPS BETWEEN n PRECEDING AND m FOLLOWING (None: unbounded), as new columns.

    Peers share a dense rank in the order, so a range of ranks is a range of peer groups.
    """
    rank = "__lk_peers"
    ranked = frame.withColumn(rank, F.dense_rank().over(window(partition, order)))
    spec = window(partition, [F.col(rank)], between=(START if preceding is None else -preceding, END if following is None else following))
    return ranked.select(*frame.columns, *(value.over(spec).alias(name) for name, value in made.items()))


def filtered_over(aggregate, value: Column, where: Column, spec: WindowSpec) -> Column:
    """aggregate(value) FILTER (WHERE where) OVER spec; of count(*), pass F.lit(1)."""
    return aggregate(F.when(where, value)).over(spec)


def over_partition(frame: DataFrame, partition: list[str], **made: Column) -> DataFrame:
    """Aggregates over whole partitions, as new columns of every row; for keys of few values.

    Rows are summed up where they are read and each gets its partition's results, so that no task gets a whole partition.
    """
    return _beside(frame, partition, frame.groupBy(*partition).agg(*(value.alias(name) for name, value in made.items())))


def sum_to_end(frame: DataFrame, partition: list[str], key: str, value: str, name: str) -> DataFrame:
    """sum(value) OVER (... ORDER BY key RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), nulls last, as column `name`; for keys of few values.

    Peers share a result, so the window is over a row for each key, and backwards from the end, where it adds each row once.
    """
    sums = frame.groupBy(*partition, key).agg(F.sum(value).alias("__lk_sum"))
    back = window(partition, [F.desc_nulls_first(key)], rows=(START, HERE))
    return _beside(frame, [*partition, key], sums.select(*partition, key, F.sum("__lk_sum").over(back).alias(name)))


def _beside(frame: DataFrame, keys: list[str], results: DataFrame) -> DataFrame:
    """Each row beside the results of its keys, null being a key too; the results are sent to every task."""
    renamed = results.withColumnsRenamed({c: f"__lk_{c}" for c in keys})
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__lk_{c}")) for c in keys))
    return frame.join(F.broadcast(renamed), same).drop(*(f"__lk_{c}" for c in keys))


def row_numbers(frame: DataFrame, name: str, lead: str, lead_order: Column, order: list[Column]) -> DataFrame:
    """row_number() over all rows by `lead_order` and then `order`, as column `name`.

    Rows meet those of equal `lead` only; how many stand before each value of `lead` comes from a count per value. So
    no task gets all rows, as it would with a window that has no partition; `lead` should have many values, or few rows each.
    """
    counts = frame.groupBy(lead).agg(F.count("*").alias("__lk_n"))
    before = F.coalesce(F.sum("__lk_n").over(Window.orderBy(lead_order).rowsBetween(START, -1)), F.lit(0))
    heads = counts.select(F.col(lead).alias("__lk_lead"), before.alias("__lk_before"))
    joined = frame.join(heads, F.col(lead).eqNullSafe(F.col("__lk_lead")))
    place = F.col("__lk_before") + F.row_number().over(Window.partitionBy(lead).orderBy(*order))
    return joined.select(*frame.columns, place.cast("bigint").alias(name))
