"""All queries of the fund-flow library; importing a module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgertide.plans import aggregate_queries, chain_queries, decoder_queries, file_queries, graph_queries, join_queries, registry, report_queries, scalar_queries, tick_queries, window_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
