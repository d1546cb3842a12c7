"""Sort keys with PostgreSQL's null placement: nulls count as greater than every value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(key: Column | str) -> Column:
    return F.col(key) if isinstance(key, str) else key


def asc(key: Column | str, nulls_first: bool = False) -> Column:
    return _column(key).asc_nulls_first() if nulls_first else _column(key).asc_nulls_last()


def desc(key: Column | str, nulls_first: bool = True) -> Column:
    return _column(key).desc_nulls_first() if nulls_first else _column(key).desc_nulls_last()
