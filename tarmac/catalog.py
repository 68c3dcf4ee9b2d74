"""Registry of the engine's queries and their DuckDB twins.

Each entry maps a stable name to ``(spark_fn, sql)``; ``spark_fn(spark,
sf_dir)`` returns a lazy DataFrame over the driver's tables, ``sql`` is the
independent DuckDB text (or ``None`` for model outputs, which are checked by
invariants in ``tests/`` instead).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    # Importing the modules fills the registry.
    from tarmac.plans import queries, service_queries  # noqa: F401
    return REGISTRY
