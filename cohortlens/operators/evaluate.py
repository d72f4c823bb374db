"""Cluster-quality metrics over the whole table: inertia, silhouette (exact Euclidean and the
linear squared form), Davies-Bouldin, Calinski-Harabasz, AIC/BIC.

``features`` is a list of numeric columns or the name of one array column.
Davies-Bouldin and Calinski-Harabasz need per-cluster centroids: one grouped
aggregate, joined back to the rows by the label, and the k x k step as
higher-order functions over the collected centroids inside one aggregate row.

The exact silhouette compares every point with every other by definition.  Equal
points (same features and label) are one weighted point, points are packed into
blocks, and a task compares its left blocks with its right ones, a pair at a time, and
emits a row of sums per point and label, so no task, broadcast or driver holds all points.  Training uses the linear form.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_POINTS = 4096
#: Right blocks of a task; labels whose sums a task holds before it emits them.
TASK_BLOCKS, MOST_LABELS = 16, 1024
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _vec(features) -> F.Column:
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(f).cast("double") for f in features])


def _sqdist(a, b) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def centroids(df: DataFrame, features, label: str) -> DataFrame:
    """One row per label: label, centroid (array<double>)."""
    if isinstance(features, str):
        at = df.select(label, F.posexplode(_vec(features)).alias("i", "v"))
        mean = at.groupBy(label, "i").agg(F.avg("v").alias("v"))
        return mean.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))),
                                                   lambda x: x["v"]).alias("centroid"))
    return df.groupBy(label).agg(F.array(*[F.avg(F.col(f).cast("double")) for f in features]).alias("centroid"))


def _per_label(df: DataFrame, features, label: str) -> DataFrame:
    """One row per label: rows, centroid, mean distance ``s`` and summed squared distance ``w`` to it."""
    both = df.select(label, _vec(features).alias("x")).join(centroids(df, features, label), label)
    d2 = _sqdist(F.col("x"), F.col("centroid"))
    return both.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.first("centroid").alias("centroid"),
                                   F.avg(F.sqrt(d2)).alias("s"), F.sum(d2).alias("w"))


def inertia(df: DataFrame, d2: str = "d2") -> DataFrame:
    """K7: sum of squared distances to the assigned centers."""
    return df.agg(F.sum(d2).alias("inertia"))


def dispersion(df: DataFrame, features, label: str) -> DataFrame:
    """K9 and K10 in one row: davies_bouldin, calinski_harabasz.

    Davies-Bouldin is the mean over clusters of the worst (s_i + s_j) / d(c_i, c_j);
    Calinski-Harabasz the between / within ratio, 1.0 when the within dispersion is 0.
    """
    agg = _per_label(df, features, label).agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum("w").alias("W"),
        F.collect_list(F.struct(F.col(label).alias("l"), "n", "centroid", "s")).alias("cl"))

    def worst(a):
        others = F.filter(F.col("cl"), lambda b: b["l"] != a["l"])
        ratios = F.transform(others, lambda b: F.when(
            _sqdist(a["centroid"], b["centroid"]) > 0,
            (a["s"] + b["s"]) / F.sqrt(_sqdist(a["centroid"], b["centroid"]))).otherwise(F.lit(0.0)))
        return F.coalesce(F.array_max(ratios), F.lit(0.0))

    scores = F.transform(F.col("cl"), worst)
    db = F.aggregate(scores, F.lit(0.0), lambda acc, v: acc + v) / F.size(scores)
    mean = F.transform(F.col("cl")[0]["centroid"], lambda _, i: F.aggregate(
        F.col("cl"), F.lit(0.0), lambda acc, c: acc + c["n"] * c["centroid"][i]) / F.col("N"))
    agg = agg.withColumn("mean", mean)
    between = F.aggregate(F.col("cl"), F.lit(0.0), lambda acc, c: acc + c["n"] * _sqdist(c["centroid"], F.col("mean")))
    ch = F.when(F.col("W") == 0, F.lit(1.0)).when(F.col("k") > 1, (
        between * (F.col("N") - F.col("k"))) / F.nullif(F.col("W") * (F.col("k") - F.lit(1)), F.lit(0.0)))
    return agg.select(db.alias("davies_bouldin"), ch.alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, features, label: str) -> DataFrame:
    return dispersion(df, features, label).select("davies_bouldin")


def calinski_harabasz(df: DataFrame, features, label: str) -> DataFrame:
    return dispersion(df, features, label).select("calinski_harabasz")


_PACKED = "block long, n long, x binary, m binary, code binary, point binary"
_SUMS = pa.schema([("point", pa.int64()), ("code", pa.int64()), ("d", pa.float64())])


def _packer(size: int):
    """Rows of points -> one row per block of at most ``size`` points, ordered by label code; vectors side by side as bytes."""
    def run(batches):
        from pyspark import TaskContext
        number, rest = TaskContext.get().partitionId() << 32, None

        def block(t):
            x = np.array(t.column("x").to_pylist(), float)
            parts = [t.column(c).to_numpy().astype(k) for c, k in (("m", float), ("code", np.int64), ("point", np.int64))]
            order = np.argsort(parts[1], kind="stable")
            blobs = [np.ascontiguousarray(v[order]).tobytes() for v in (x, *parts)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(x)], pa.int64()), *[pa.array([v], pa.binary()) for v in blobs]],
                                              ["block", "n", "x", "m", "code", "point"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            while rest.num_rows >= size:
                yield block(rest.slice(0, size))
                rest, number = rest.slice(size), number + 1
        if rest is not None and rest.num_rows:
            yield block(rest)
    return run


def _block_sums(batches):
    """Pairs of blocks, those of a left block one after another -> for each left point, the weighted sum of
    distances to the right points of each label."""
    at, sums, point, x = None, {}, None, None

    def out():
        for code, d in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(np.full(len(d), code)), pa.array(d)], schema=_SUMS)
        sums.clear()

    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            if row["block"].as_py() != at:
                yield from out()
                at, point = row["block"].as_py(), np.frombuffer(row["point"].as_buffer(), np.int64)
                x = np.frombuffer(row["x"].as_buffer()).reshape(len(point), -1)
            y = np.frombuffer(row["right_x"].as_buffer()).reshape(row["right_n"].as_py(), -1)
            weight, code = np.frombuffer(row["right_m"].as_buffer()), np.frombuffer(row["right_code"].as_buffer(), np.int64)
            codes, starts = np.unique(code, return_index=True)
            found = np.concatenate([np.add.reduceat(pairwise_dist(x[a:a + 256], y) * weight, starts, axis=1) for a in range(0, len(x), 256)])
            for j, c in enumerate(codes.tolist()):
                sums[c] = sums[c] + found[:, j] if c in sums else found[:, j].copy()
            if len(sums) > MOST_LABELS:
                yield from out()
    yield from out()


def _label_sums(points: DataFrame) -> DataFrame:
    """(point, code, d): each point's weighted sum of distances to the points of each label.

    Points travel once, packed into blocks; a task reads its left blocks and its right blocks from their files, so no point is
    shuffled once per block, and emits a left block's sums once for all its right blocks.
    """
    from ..session import fresh_path, materialize
    spark, rows = points.sparkSession, points.count()
    size = min(BLOCK_POINTS, max(256, -(-rows // 16)))
    blocks = max(1, -(-rows // size))
    path = fresh_path(spark, "silhouette-blocks")
    (points.select("x", "m", "code", "point").repartition(-(-blocks // 8)).mapInArrow(_packer(size), _PACKED)
     .write.option("maxRecordsPerFile", 1).parquet(path))
    left = spark.read.schema(_PACKED).parquet(path)
    right = left.select(*[F.col(c).alias(f"right_{c}") for c in ("n", "x", "m", "code")]).coalesce(-(-blocks // TASK_BLOCKS))
    pairs = left.select("block", "point", "x").hint("shuffle_replicate_nl").crossJoin(right)
    before = spark.conf.get(_BATCH_ROWS, None)
    spark.conf.set(_BATCH_ROWS, "4")  # a row holds two blocks
    try:
        return materialize(pairs.mapInArrow(_block_sums, "point long, code long, d double"), "silhouette-sums")
    finally:
        if before is None:
            spark.conf.unset(_BATCH_ROWS)
        else:
            spark.conf.set(_BATCH_ROWS, before)


def silhouette_exact(df: DataFrame, features, label: str) -> DataFrame:
    """K8 (fidelity form): mean silhouette with Euclidean distances over all rows; NULL below two labels."""
    from ..session import materialize, ship_package
    ship_package(df.sparkSession)
    points = df.select(F.col(label).alias("l"), _vec(features).alias("x")).groupBy("l", "x").agg(F.count(F.lit(1)).alias("m"))
    labels = df.groupBy(F.col(label).alias("name")).agg(F.count(F.lit(1)).alias("size")).withColumn("code", F.xxhash64("name"))
    points = materialize(points.join(labels, F.col("l").eqNullSafe(F.col("name")))
                         .withColumn("point", F.monotonically_increasing_id()), "silhouette-points")
    sums = _label_sums(points).groupBy("point", "code").agg(F.sum("d").alias("d"))
    sizes = labels.select(F.col("code").alias("other"), F.col("size").alias("other_size"))
    pairs = sums.join(sizes, sums["code"] == sizes["other"]).join(
        points.select("point", F.col("code").alias("mine"), "m"), "point")
    own = F.col("mine") == F.col("other")
    per = pairs.groupBy("point").agg(
        F.first("m").alias("m"), F.max(F.when(own, F.col("other_size"))).alias("n"),
        F.max(F.when(own & (F.col("other_size") > 1), F.col("d") / (F.col("other_size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("d") / F.col("other_size"))).alias("b"))
    top = F.greatest("a", "b")
    value = F.when((F.col("n") <= 1) | (top == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return per.filter("b is not null").agg((F.sum(value * F.col("m")) / F.sum("m")).alias("silhouette"))


def pairwise_dist(A, X):
    """Euclidean distances between the rows of ``A`` and ``X`` (a block x n matrix).

    Low dimensions subtract directly (exact); higher ones use
    ``|a|^2 + |x|^2 - 2 a.x`` so memory stays block x n instead of block x n x d.
    """
    if X.shape[1] <= 8:
        diff = A[:, None, :] - X[None, :, :]
        return np.sqrt((diff * diff).sum(axis=2))
    d2 = (A * A).sum(axis=1)[:, None] + (X * X).sum(axis=1)[None, :] - 2.0 * (A @ X.T)
    d2 = np.maximum(d2, 0.0)
    # equal points: cancellation leaves a small remainder instead of zero
    return np.sqrt(np.where(d2 < 1e-12 * (A * A).sum(axis=1)[:, None], 0.0, d2))


def silhouette_squared(df: DataFrame, features_vec: str = "features", prediction: str = "prediction") -> float:
    """K8 (Spark ML form): ClusteringEvaluator, squared Euclidean, linear in the table size."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    ev = ClusteringEvaluator(featuresCol=features_vec, predictionCol=prediction,
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(df))


def aic_bic(log_likelihood: float, n: int, k: int, d: int, covariance: str) -> tuple[float, float]:
    """AIC and BIC of a Gaussian mixture from its log-likelihood on the data it is scored on."""
    if covariance == "full":
        p = k * d + k * d * (d + 1) // 2 + k - 1
    elif covariance == "diag":
        p = 2 * k * d + k - 1
    else:
        raise ValueError(covariance)
    return -2 * log_likelihood + 2 * p, -2 * log_likelihood + p * math.log(n)
