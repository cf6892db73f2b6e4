"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.plans import evidence_queries, export_queries, feed_queries, gold_queries, ingest_queries, match_queries, mention_queries, polygon_queries, report_queries, scalar_queries, stream_queries, tile_queries

_MODULES = (gold_queries, scalar_queries, evidence_queries, ingest_queries, stream_queries, report_queries, tile_queries, polygon_queries, match_queries, feed_queries, export_queries, mention_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
