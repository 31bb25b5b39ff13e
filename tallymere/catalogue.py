"""Names of the engine's queries, their builders and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import ledger_queries, record_queries, review_queries, rule_queries, run_queries, store_queries

FLAGSHIP = "flagship_routing_summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (rule_queries, ledger_queries, review_queries, run_queries, record_queries, store_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
