"""Registry of the checkable queries: key -> Spark builder, key -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
BENCH: list[str] = []


def register(key: str, sql: str | None = None, bench: bool = False):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``.

    ``sql`` is the DuckDB equivalent over the given tables; ``None`` marks a
    rows-only key (fitted models, sign-ambiguous algebra).
    """

    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        if bench:
            BENCH.append(key)
        return fn

    return deco


MODULES = ("q_sources", "q_clean", "q_features", "q_tokens", "q_vectors", "q_neighbors",
           "q_aggregates", "q_splits", "q_resample", "q_evaluate", "q_models", "q_scoring")


def load_all() -> None:
    """Import the query modules; importing fills the registry."""
    import importlib

    for m in MODULES:
        try:
            importlib.import_module(f"lurescan.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"lurescan.plans.{m}":
                raise
