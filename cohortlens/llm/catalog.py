"""All queries of this folder: importing the operator modules fills the registry."""

from __future__ import annotations

from . import (  # noqa: F401
    decontamination, divergence, fingerprint, language, manifest, mixing, neighbours, packing, quality, sharding, simhash,
    substring, warc,
)
from .common import prepare
from .registry import ORACLES, QUERIES, Query


def load_all() -> dict[str, Query]:
    """Queries by name; each first ships the package and sets the Arrow batch size."""
    def prepared(fn: Query) -> Query:
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return run
    return {name: prepared(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
