"""Registry of named queries (one per SURVEY section 2 operator) and their DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``. Modules register with
the ``query`` decorator; ``__spark_entry__`` only re-exports these dicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .context import Ctx

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(ctx) -> DataFrame`` under ``name`` with its oracle SQL (None = no SQL twin)."""

    def deco(fn: Callable[[Ctx], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Ctx.get(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from .plans import queries_analytics, queries_catalog, queries_commit, queries_context, queries_core, queries_domains, queries_evidence, queries_ingestion, queries_intake, queries_matching, queries_quality, queries_sinks, queries_store, queries_streaming  # noqa: F401
