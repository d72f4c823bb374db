"""Registry of named queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or data Spark derives from them), so
its work grows with them.  Parameters (segment filter, search id, sample
size, k) are fixed defaults here and ordinary arguments in the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the plan modules fills the registry
    from . import report_queries, model_queries, io_queries, stream_queries  # noqa: F401
    return dict(QUERIES)
