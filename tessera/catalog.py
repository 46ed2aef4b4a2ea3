"""Every query by name, with the SQL that expresses it, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import settled

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name."""

    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(settled(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


from tessera.plans import columns, evaluation, graph, lifecycle, more_retrieval, recall, retrieval, scans, transcripts  # noqa: E402, F401
