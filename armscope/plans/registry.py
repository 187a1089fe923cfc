"""The list of registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from armscope.plans.fixtures import oracle_text

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``oracle`` only its rows are checked."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return fn

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from armscope.plans import (  # noqa: F401
        parsing_queries, pairing_queries, result_queries, scoring_queries, source_queries,
        stats_queries, streaming_queries, structure_queries, training_queries, voting_queries,
    )
