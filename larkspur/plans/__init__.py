"""Queries by category; importing this package registers all of them."""

from . import registry  # noqa: F401  isort: skip
from . import aggregates, joins, pg, predicates, scalars, scans, sorting, supersets, tpch, windows  # noqa: F401
