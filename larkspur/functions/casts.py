"""Casts whose results differ between the engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_to_bool(x: Column) -> Column:
    return x != 0


def float_to_int(x: Column, kind: str = "int") -> Column:
    """float to integer: halves go to the even neighbour; what does not fit is an error."""
    return F.rint(x).cast(kind)


def numeric_to_int(x: Column, kind: str = "int") -> Column:
    """numeric to integer: halves go away from zero."""
    return F.round(x, 0).cast(kind)


def text_to_numeric(x: Column, precision: int = 38, scale: int = 16) -> Column:
    """text to numeric; NaN and infinities are no numerics here and raise an error, as any other bad text does."""
    return x.cast(f"decimal({precision},{scale})")


def subscript(x: Column, i: Column | int) -> Column:
    """x[i], counted from 1; null outside the array."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.when(at >= 1, F.get(x, at - 1))
