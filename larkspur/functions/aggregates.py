"""Aggregates with PostgreSQL's result types and exactness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_int(x: Column) -> Column:
    """sum of smallint or integer: bigint."""
    return F.sum(x.cast("bigint"))


def sum_bigint(x: Column) -> Column:
    """sum of bigint: numeric(38,0), which many more rows than 64 bits hold cannot overflow."""
    return F.sum(x.cast("decimal(19,0)")).cast("decimal(38,0)")


def sum_float4(x: Column) -> Column:
    return F.sum(x.cast("double")).cast("float")


def avg_exact(x: Column, scale: int = 0, distinct: bool = False) -> Column:
    """avg of integers (scale 0) or numerics of a scale: numeric(38,16), halves away from zero.

    The sum is exact; its whole quotient by the count, and the quotient of what is left, are exact too, so that only the
    last digit is rounded, and once.
    """
    value = x.cast(f"decimal({19 + scale},{scale})")
    total, n = (F.sum_distinct(value), F.count_distinct(value)) if distinct else (F.sum(value), F.count(value))
    total, n = total.cast(f"decimal({20 + scale},{scale})"), n.cast("decimal(15,0)")
    size = F.abs(total)
    whole = F.floor(size / n).cast("decimal(20,0)")
    rest = (size - (whole * n)).cast(f"decimal({15 + scale},{scale})")
    fraction = F.round(rest / n, 16).cast("decimal(18,16)")
    made = (whole.cast("decimal(21,0)") + fraction).cast("decimal(38,16)")
    return F.when(n > 0, F.when(total < 0, -made).otherwise(made))


def string_agg(x: Column, delimiter: str, *order: Column, distinct: bool = False) -> Column:
    """Texts joined in the order of `order` (of the texts themselves if not given); nulls are left out, none gives null."""
    rows = F.collect_set(x) if distinct else F.collect_list(F.when(x.isNotNull(), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), x.alias("x"))))
    ordered = F.sort_array(rows)
    return F.when(F.size(rows) > 0, F.array_join(ordered if distinct else F.transform(ordered, lambda r: r["x"]), delimiter))


def grouping_mask(*keys: str) -> Column:
    """GROUPING(a, b, ...): a bit for each key that the row does not group by, the last key's lowest."""
    return sum((F.grouping(k).cast("int") * (1 << i) for i, k in enumerate(reversed(keys))), F.lit(0)).cast("int")


def filtered(value: Column, where: Column) -> Column:
    """The argument of an aggregate with FILTER (WHERE ...), for places where SQL's own FILTER is not allowed (windows)."""
    return F.when(where, value)
