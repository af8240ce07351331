"""Every checked query: a Spark callable and, where SQL can say it, the same in DuckDB SQL.

The query modules register themselves on import; ``QUERIES`` and ``SQL`` are what the
driver contract in ``__spark_entry__`` hands out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its optional SQL counterpart."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name!r} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


def load() -> None:
    """Import every query module once."""
    from . import catalog, imagery, manifests, rasters, scalars, streams, traces, warping  # noqa: F401
