"""Registry of named queries: a Spark plan plus (optionally) its DuckDB oracle SQL."""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from apptflow.sources.adapters import shared_plans

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | Callable[[], str] | None]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the independent DuckDB oracle; ``None`` means the query has no
    SQL twin (model training) and is checked rows-only.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with shared_plans():
                return fn(spark, sf_dir)

        REGISTRY[name] = (run, sql)
        return run
    return deco


def _load_all() -> None:
    # importing the modules registers their queries
    from apptflow.plans import q_core, q_metrics, q_draws, q_sampling, q_features, q_booking  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: fn for k, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    out = {}
    for k, (_, sql) in REGISTRY.items():
        if sql is not None:
            out[k] = sql() if callable(sql) else sql
    return out

