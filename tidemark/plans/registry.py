"""All queries of the library and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import bar_queries, evidence_queries, locked_queries, model_queries, resampling_queries, scalar_queries, screen_queries, state_queries

FLAGSHIP = "band_event_returns"

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Query, str | None]] = {**bar_queries.ENTRIES, **evidence_queries.ENTRIES, **model_queries.ENTRIES, **state_queries.ENTRIES, **resampling_queries.ENTRIES, **screen_queries.ENTRIES, **scalar_queries.ENTRIES, **locked_queries.ENTRIES}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
