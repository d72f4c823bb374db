"""Helpers shared by the operators: words, row numbers, running sums, Arrow batch size.

Words are maximal runs of anything but ASCII white space (space and bytes 9-13),
the same rule in Python (``bytes.split``) and in SQL (``WORD_REGEX``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from ..sources.tables import read_table

__all__ = ["WORD_REGEX", "materialize", "read_table", "prepare", "add_prefix", "arrow_map", "bytes_column"]

WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Rows per Arrow batch: texts may be long, so a batch stays near a few MB.
ARROW_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers and keep Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def bytes_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column of a batch as UTF-8 bytes, without decoding it."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; tables come out in pieces of bounded rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch) if batch.num_rows else None
            if isinstance(out, pa.Table):
                yield from out.to_batches(max_chunksize=50_000)
            elif out is not None:
                yield out
    return df.mapInArrow(run, schema)


def add_prefix(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], buckets: int) -> DataFrame:
    """Exclusive running sums of ``sums`` within ``keys``, with no task holding a whole key.

    Rows of a key are ordered by (hash bucket of ``order``, ``order``).  Sums of
    the (key, bucket) cells are added up over the at most ``buckets`` cells of a
    key; only the rows of one cell meet in one window.  With ``F.lit(1)`` as the
    value the result is a gapless row number from 0.  Null keys form a group.
    """
    df = df.withColumn("_cell", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(buckets)))
    df = df.withColumns({f"_v_{out}": value.cast("long") for out, value in sums.items()})
    cell = [*keys, "_cell"]
    totals = df.groupBy(*cell).agg(*[F.sum(f"_v_{out}").alias(f"_t_{out}") for out in sums])
    before = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in cell],
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums])
    inside = W.partitionBy(*cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({f"_p_{out}": F.coalesce(F.sum(f"_v_{out}").over(inside), F.lit(0)) for out in sums})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in cell]
    df = df.join(offsets, on, "inner")
    df = df.withColumns({out: F.col(f"_p_{out}") + F.col(f"_o_{out}") for out in sums})
    return df.drop("_cell", *[f"_k_{k}" for k in cell], *[f"_{p}_{out}" for out in sums for p in ("v", "p", "o")])


def buckets_for(rows: int, per_bucket: int | None = None) -> int:
    """Cells for ``rows``: of ``per_bucket`` rows, or else about as many cells as rows in one, 1000 rows at least."""
    return max(1, -(-rows // (per_bucket or max(1000, math.isqrt(rows)))))
