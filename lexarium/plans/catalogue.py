"""Named queries over the tables of a folder, each with its DuckDB form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexarium.plans import conversation_sql, full_search, preparation, search, stored_index, surface

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = search.QUERIES | preparation.QUERIES | surface.QUERIES | full_search.QUERIES | stored_index.QUERIES
ORACLE_SQL: dict[str, str] = search.ORACLE_SQL | preparation.ORACLE_SQL | surface.ORACLE_SQL | full_search.ORACLE_SQL | stored_index.ORACLE_SQL | {"conversation_chunks": conversation_sql.CONVERSATION_CHUNKS}
