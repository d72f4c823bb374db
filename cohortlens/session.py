"""Spark session and shared work-directory helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Files are small per table here; at cluster scale 128 MB splits are the norm.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "cohortlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster the master and shuffle width come from the submit
    configuration; locally they default to all cores and 8 partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is None and not os.environ.get("SPARK_MASTER"):
        master = "local[*]"
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    elif master and master.startswith("local"):
        conf["spark.sql.shuffle.partitions"] = "8"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    It is read from the session.  Only when it is unset and the master is
    ``local`` (tests) a private folder is created and registered as the
    checkpoint folder; on a cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
    else:
        # make sure RDD/Dataset checkpoints land there as well
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder (never reused, never cleared)."""
    return f"{shared_dir(spark)}/cohortlens/{name}/{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Cut lineage by writing ``df`` once as parquet under the shared folder and reading it back.

    Unlike an eager ``checkpoint()``, which runs the plan once for its count and
    again to write the files, this computes the plan exactly once; the files
    survive the loss of any executor.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cohortlens`` importable in the Python workers (as ``--py-files`` would).

    Arrow-batched UDF stages pickle functions that live in this package, so
    every executor needs it on its path.  The package is zipped into a new
    private folder once per application; repeated calls are no-ops.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    files = [os.path.join(d, n) for d, _dirs, names in os.walk(pkg_dir) for n in names if n.endswith(".py")]
    out = os.path.join(tempfile.mkdtemp(prefix="cohortlens-"), "cohortlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(files):
            z.write(f, os.path.relpath(f, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
