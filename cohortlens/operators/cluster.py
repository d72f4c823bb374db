"""Clustering over the whole table: Spark ML k-means with best-of-seeds, mixtures as column expressions, Lloyd steps.

``multifit`` fits many models in shared passes and is what training uses.  Spark ML has no ``n_init``: the seeds are fitted as concurrent Spark jobs
(driver threads, as CrossValidator's ``parallelism`` does) over ONE persisted
vector frame, and the lowest training cost wins (ties to the first seed).
Every fit reads every row; frames are persisted and released by the caller.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S

PARALLEL_FITS = 6


def vectors(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Feature vector by column name; invalid values are an error, not skipped."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


@dataclass
class FitResult:
    model: object
    cost: float
    seed: int
    n_iter: int

    @property
    def centers(self) -> list[list[float]]:
        return [list(map(float, c)) for c in self.model.clusterCenters()]


@dataclass
class MixtureFit:
    """A Gaussian mixture: weights, means, covariance matrices, mean log-likelihood per row."""
    weights: list[float]
    means: list[list[float]]
    covariances: list[list[list[float]]]
    mean_ll: float
    n_iter: int
    n_rows: int


def center_tol(k: int, mean_var: float, rel_tol: float = 1e-4) -> float:
    """Spark's per-center movement bound equivalent to a budget for the sum of squared shifts.

    The sum is to stay below ``rel_tol * mean feature variance``; Spark stops when
    EVERY center moved less than ``tol``, so ``tol = sqrt(budget / k)`` is enough.
    """
    return math.sqrt(rel_tol * mean_var / k)


def seeds_for(n_init: int, base: int = S.SAMPLE_SEED) -> list[int]:
    return [base + i for i in range(n_init)]


def mean_variance(df: DataFrame, cols: list[str]) -> float:
    """Mean population variance of the features (one aggregate)."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    return sum(float(row[c] or 0.0) for c in cols) / len(cols)


def fit_kmeans(vec: DataFrame, k: int, seeds: list[int], tol: float, max_iter: int = 300) -> FitResult:
    """K1: one Spark ML k-means per seed (concurrently); the lowest cost wins."""
    def one(seed: int) -> FitResult:
        m = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="features").fit(vec)
        return FitResult(m, float(m.summary.trainingCost), seed, int(m.summary.numIter))

    with ThreadPoolExecutor(max_workers=min(PARALLEL_FITS, len(seeds))) as pool:
        return min(pool.map(one, seeds), key=lambda r: r.cost)


def best_k(rows: list[tuple[int, float, float]]) -> int:
    """H4: first k with the maximal silhouette."""
    top = max(r[2] for r in rows if r[2] is not None)
    return next(r[0] for r in rows if r[2] == top)


# ---------------------------------------------------------------------------
# Gaussian mixtures (fitted in ``multifit``)
# ---------------------------------------------------------------------------
def _log_density(X: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    out = np.empty((len(weights), len(X)))  # a component's densities lie side by side
    for j, (w, mu, cov) in enumerate(zip(weights, means, covariances)):
        diff, inverse = np.ascontiguousarray((X - mu).T), np.linalg.inv(cov)
        quad = sum(diff[a] * sum(inverse[a, b] * diff[b] for b in range(len(mu))) for a in range(len(mu)))
        out[j] = math.log(max(w, 1e-300)) - 0.5 * (len(mu) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + quad)
    return out.T


def log_densities(cols: list[str], fit: MixtureFit) -> list:
    """Per component, log(weight) + log density, as column expressions."""
    out = []
    for w, mu, cov in zip(fit.weights, fit.means, fit.covariances):
        inverse = np.linalg.inv(np.array(cov))
        constant = math.log(max(w, 1e-300)) - 0.5 * (len(mu) * math.log(2 * math.pi) + np.linalg.slogdet(np.array(cov))[1])
        quad = F.lit(0.0)
        for i, a in enumerate(cols):
            for j, b in enumerate(cols):
                quad = quad + (F.col(a) - F.lit(mu[i])) * F.lit(float(inverse[i, j])) * (F.col(b) - F.lit(mu[j]))
        out.append(F.lit(float(constant)) - F.lit(0.5) * quad)
    return out


def mixture_label(cols: list[str], fit: MixtureFit):
    """The component of maximal posterior (ties to the lowest id), as a column."""
    scores = F.array(*log_densities(cols, fit))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def mixture_log_likelihood(df: DataFrame, cols: list[str], fit: MixtureFit) -> DataFrame:
    """(log_likelihood, n): the total over all rows, one aggregate."""
    parts = log_densities(cols, fit)
    top = F.greatest(*parts)
    total = F.log(sum((F.exp(p - top) for p in parts[1:]), F.exp(parts[0] - top)))
    return df.agg(F.sum(top + total).alias("log_likelihood"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Lloyd steps from given centers
# ---------------------------------------------------------------------------
def lloyd_steps(df: DataFrame, cols: list[str], centers: list[list[float]], steps: int) -> DataFrame:
    """(cluster, n, center): ``steps`` exact Lloyd steps from ``centers``, each one grouped aggregate."""
    from ..functions import distance as D
    now = [list(map(float, c)) for c in centers]
    for step in range(steps):
        labelled = df.withColumn("cluster", D.nearest_index(D.distance_array(cols, now)))
        moved = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])
        if step == steps - 1:
            return moved.select("cluster", "n", *cols)
        for r in moved.collect():  # one row per center
            now[r["cluster"]] = [float(r[c]) for c in cols]
    raise ValueError("at least one step")
