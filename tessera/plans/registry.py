"""Registered queries: one per operator, each over whole given tables, with its DuckDB twin."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str = None):
    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load() -> None:
    """Import the modules that register queries."""
    from . import queries_corpus, queries_facts, queries_files, queries_harness, queries_io, queries_render, queries_scores, queries_sources  # noqa: F401
