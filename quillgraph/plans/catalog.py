"""Queries over the reference's own operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, linking_queries, memory_queries, quality_queries, reader_queries, retrieval_queries, source_queries, stream_queries, table_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

for module in (graph_queries, text_queries, retrieval_queries, memory_queries, quality_queries, linking_queries, source_queries, reader_queries, table_queries, stream_queries):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
