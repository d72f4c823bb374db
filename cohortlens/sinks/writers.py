"""Sinks: tables, CSV exports, JSON documents, run history and model artifacts.

Every write goes through Spark's job commit protocol, to a path under the
cluster-shared folder.  What replaces an existing table or document is written
to a new version folder and published by one small pointer record, so readers
see the old version or the new one, never a half.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

SEGMENTED_PUBLIC = {
    S.CUSTOMER_ID: "CustomerID", S.GENDER: "Gender", S.AGE: "Age", S.INCOME: "Annual Income (k$)",
    S.SCORE: "Spending Score (1-100)", "gender_enc": "Gender_Enc", "cluster": "Cluster", "segment": "Segment",
    "r_proxy": "R_proxy", "f_proxy": "F_proxy", "m_proxy": "M_proxy", "rfm_segment": "RFM_Segment",
}


def to_public(df: DataFrame) -> DataFrame:
    """Restore the file's public column names (unknown columns keep theirs)."""
    return df.select(*[F.col(c).alias(SEGMENTED_PUBLIC.get(c, c)) for c in df.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """B1: full-width table write (atomic through the commit protocol)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


POINTER_SCHEMA = "version string, seq bigint"


def publish(df: DataFrame, base: str, fmt: str = "parquet") -> str:
    """B1: write ``df`` as a new version below ``base``, then append the pointer to it."""
    spark = df.sparkSession
    version = f"{base}/versions/{uuid.uuid4().hex}"
    write_table(df, version, fmt)
    _point(spark, base, version)
    return version


def publish_clustered(df: DataFrame, base: str, keys: list[str], partitions: int | None = None,
                      row_group_bytes: int | None = None) -> str:
    """B1 for lookups: a new version whose files hold ranges of ``keys`` in order, with bloom filters on them.

    A filter on a key then reads the row groups whose range and bloom filter admit it (of the first key, at most two
    unless the value fills more); Spark pushes such filters to the scan by itself.
    """
    ordered = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    spark = df.sparkSession
    version = f"{base}/versions/{uuid.uuid4().hex}"
    w = ordered.sortWithinPartitions(*keys).write.mode("overwrite")
    for key in keys:
        w = w.option(f"parquet.bloom.filter.enabled#{key}", "true")
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    w.parquet(version)
    _point(spark, base, version)
    return version


def _point(spark: SparkSession, base: str, version: str) -> None:
    spark.createDataFrame([(version, time.time_ns())], POINTER_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/published")


def published(spark: SparkSession, base: str) -> str:
    """The path of the version published last (a few pointer rows)."""
    return spark.read.schema(POINTER_SCHEMA).json(f"{base}/published").orderBy(F.col("seq").desc()).first()["version"]


def write_required(df: DataFrame, path: str) -> str:
    """B2: the five required columns under their public names, as CSV (re-usable as input)."""
    return write_table(to_public(df.select(*S.INTERNAL_COLUMNS)), path, fmt="csv")


def write_records(df: DataFrame, path: str) -> str:
    """JSON-lines records for plots and APIs."""
    df.write.mode("overwrite").json(path)
    return path


METRICS_SCHEMA = T.StructType([
    T.StructField("silhouette", T.DoubleType()), T.StructField("davies", T.DoubleType()),
    T.StructField("calinski", T.DoubleType()), T.StructField("inertia", T.DoubleType()),
    T.StructField("aic", T.DoubleType()), T.StructField("bic", T.DoubleType()),
    T.StructField("n_iter", T.IntegerType()), T.StructField("model_variant", T.StringType()),
    T.StructField("preprocessor_variant", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("best_k", T.IntegerType()), T.StructField("final_k", T.IntegerType()),
    T.StructField("candidate_results", T.ArrayType(T.StructType([
        T.StructField("variant", T.StringType()), T.StructField("preprocessor", T.StringType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("silhouette", T.DoubleType()), T.StructField("davies", T.DoubleType()),
        T.StructField("calinski", T.DoubleType()), T.StructField("inertia", T.DoubleType()),
        T.StructField("aic", T.DoubleType()), T.StructField("bic", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]))),
])

FEATURES_SCHEMA = T.StructType([
    T.StructField("features", T.ArrayType(T.StringType())), T.StructField("variant", T.StringType()),
    T.StructField("preprocessor", T.StringType()),
])

RUN_SCHEMA = T.StructType([
    T.StructField("dataset_label", T.StringType()), T.StructField("dataset_path", T.StringType()),
    T.StructField("trained_at", T.StringType()), T.StructField("rows", T.LongType()),
    T.StructField("silhouette", T.DoubleType()),
])

# Values of the metrics document's fields where a stored document lacks them.
METRICS_DEFAULTS = {"model_variant": "kmeans", "preprocessor_variant": "standard", "n_iter": 0}


def write_document(spark: SparkSession, payload: dict, schema: T.StructType, path: str) -> str:
    """One JSON document (a one-row dataset, a single file)."""
    return publish(spark.createDataFrame([payload], schema).coalesce(1), path, "json")


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A4: a published document."""
    return parse_documents(spark, published(spark, path), schema)


def parse_documents(spark: SparkSession, path: str, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """JSON documents, one per file, on one line or indented over several.

    Absent fields read as NULL or their value in ``defaults``.
    """
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.fillna(defaults) if defaults else df


def append_run(spark: SparkSession, path: str, label: str, data_path: str, rows: int,
               silhouette: float | None, trained_at: str | None = None) -> None:
    """Append one training-run record to the run history."""
    stamp = trained_at or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    row = {"dataset_label": label, "dataset_path": data_path, "trained_at": stamp, "rows": int(rows),
           "silhouette": silhouette}
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").json(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Append run records (the columns of ``RUN_SCHEMA``)."""
    runs.select(*RUN_SCHEMA.fieldNames()).coalesce(1).write.mode("append").json(path)


def latest_runs(spark: SparkSession, path: str) -> DataFrame:
    """Latest run per dataset label, with the number of its runs; of runs of one second that with the greatest path, then rows."""
    from pyspark.sql import Window
    hist = spark.read.schema(RUN_SCHEMA).json(path)
    w = Window.partitionBy("dataset_label").orderBy(
        F.col("trained_at").desc(), F.col("dataset_path").desc_nulls_last(), F.col("rows").desc_nulls_last(), F.col("silhouette").desc_nulls_last())
    runs = F.count(F.lit(1)).over(Window.partitionBy("dataset_label"))
    return hist.withColumn("_rn", F.row_number().over(w)).withColumn("runs", runs).filter("_rn = 1").drop("_rn")


def save_model(spark: SparkSession, model, path: str, ml_model=None) -> str:
    """Model state as a one-line text dataset (+ the Spark ML model when given)."""
    publish(spark.createDataFrame([(model.to_json(),)], "json string").coalesce(1), f"{path}/segment_model", "text")
    if ml_model is not None:
        ml_model.write().overwrite().save(f"{path}/ml_model")
    return path


def load_model(spark: SparkSession, path: str):
    """A5: load the model state saved by :func:`save_model`."""
    from ..operators.scoring import SegmentModel
    text = spark.read.text(published(spark, f"{path}/segment_model")).first()[0]
    return SegmentModel.from_json(text)
