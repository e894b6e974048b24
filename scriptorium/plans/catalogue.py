"""Every registered query of the engine's own operators, and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.plans import docx_queries, format_queries, identity_queries, process_queries, record_queries, research_queries, score_queries, table_queries, text_queries

ALL = {**text_queries.QUERIES, **table_queries.QUERIES, **score_queries.QUERIES, **format_queries.QUERIES, **identity_queries.QUERIES, **process_queries.QUERIES, **research_queries.QUERIES, **docx_queries.QUERIES, **record_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: query for key, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for key, (_, sql) in ALL.items() if sql}
