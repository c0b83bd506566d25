"""All registered queries over the driver's tables, and the SQL that they are compared with."""

from __future__ import annotations

from . import queries_dims, queries_rows, queries_scale, queries_series

QUERIES = queries_rows.QUERIES | queries_series.QUERIES | queries_dims.QUERIES | queries_scale.QUERIES
ORACLE_SQL = queries_rows.ORACLE_SQL | queries_series.ORACLE_SQL | queries_dims.ORACLE_SQL | queries_scale.ORACLE_SQL
