"""Versions of a table numbered by the batch or day that made them.

A step reads the last version below its own number and overwrites its own, so a step
that runs again after a crash starts from the same state and replaces what it wrote.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def path_of(base: str, number: int) -> str:
    return f"{base}/version={number}"


def numbers(spark: SparkSession, base: str) -> list[int]:
    """The complete versions below ``base`` (one folder each, listed by the shared file system)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(base)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [re.fullmatch(r"version=(-?\d+)", f.getPath().getName()) for f in fs.listStatus(at)]
    done = [int(m[1]) for m in found if m]
    return sorted(n for n in done if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path_of(base, n)}/_SUCCESS")))


def write(df: DataFrame, base: str, number: int) -> DataFrame:
    df.write.mode("overwrite").parquet(path_of(base, number))
    return df.sparkSession.read.parquet(path_of(base, number))


def before(spark: SparkSession, base: str, number: int) -> DataFrame | None:
    """The last version below ``number``; None if there is none."""
    found = [n for n in numbers(spark, base) if n < number]
    return spark.read.parquet(path_of(base, found[-1])) if found else None


def latest(spark: SparkSession, base: str) -> DataFrame | None:
    found = numbers(spark, base)
    return spark.read.parquet(path_of(base, found[-1])) if found else None
