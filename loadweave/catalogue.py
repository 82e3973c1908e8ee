"""Every query of the engine outside the training-data subpackage, with its DuckDB equivalent."""

from __future__ import annotations

from .plans import load, logs, series, side, space

QUERIES = load.QUERIES
ORACLE_SQL = load.SQL
_MODULES = (series, space, logs, side)  # they add their queries to the same tables
