"""Registered queries: name to callable, name to DuckDB SQL."""

from . import aggregates, joins, models, recursive, scalars, sources, streams, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
