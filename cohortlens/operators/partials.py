"""Partial sums for iterative algorithms (EM, Lloyd refinement, mini-batch, lambda search).

Each iteration ships its parameters as a broadcast variable to tasks that
fold their partition into ONE row of partial sums (numpy on Arrow batches);
a fixed-shape global sum then reduces those rows.  The Spark plan is the same
in every iteration - no parameters are inlined as literals, so nothing is recompiled -
and the work is the treeAggregate pattern Spark ML uses: map-side combine,
then a tree reduction of one short row per task (at most 64 reach the driver).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_OUT = T.StructType([T.StructField("v", T.ArrayType(T.DoubleType()))])
_FAN_IN = 64
#: Most rows of a task where every step of a fit reads the whole frame.
TASK_ROWS = 131_072


def spread(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` dealt to all cores: a planner that merges small partitions by bytes leaves a frame of a few numbers a row to a
    task or two, and every step of a fit to as many cores.  A table of one small task stays as it is."""
    if n_rows <= TASK_ROWS // 4:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS)))


def task_count(df: DataFrame) -> int:
    """Partitions of a (persisted) frame: read once per fit, not once per step."""
    return df.rdd.getNumPartitions()


def batch_sums(df: DataFrame, cols: list[str], fn: Callable[[np.ndarray, object], np.ndarray],
               length: int, params, tasks: int | None = None) -> np.ndarray:
    """Sum of ``fn(X_batch, params)`` (a vector of ``length``) over all rows of ``df``."""
    from ..session import ship_package
    ship_package(df.sparkSession)
    bc = df.sparkSession.sparkContext.broadcast(params)

    def part(it):
        acc = np.zeros(length)
        p = bc.value
        for pdf in it:
            if len(pdf):
                acc += fn(pdf[cols].to_numpy(dtype=float), p)
        yield pd.DataFrame({"v": [acc.tolist()]})

    def fold(it):
        acc = np.zeros(length)
        for pdf in it:
            for v in pdf["v"]:
                acc += np.asarray(v, dtype=float)
        yield pd.DataFrame({"v": [acc.tolist()]})

    partial = df.select(*cols).mapInPandas(part, _OUT)
    if (tasks or task_count(df)) > _FAN_IN:
        # second tree level: one row per task folded into at most _FAN_IN rows
        partial = partial.repartition(_FAN_IN).mapInPandas(fold, _OUT)
    rows = partial.collect()  # at most _FAN_IN short vectors
    bc.unpersist()
    total = np.zeros(length)
    for r in rows:
        total += np.asarray(r["v"], dtype=float)
    return total
