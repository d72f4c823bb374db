"""Many fits over one frame in one pass a step: k-means, mixtures raced by likelihood, mini-batch k-means, metrics.

A ``Fit`` is one model (its columns of the frame, k, seed, state).  A step ships the
state of all fits still running as one broadcast; a task folds its rows into one packed
array of partial sums for all of them, and the driver gets the total (``partials``).
Finished fits drop out, so the number of Spark jobs is that of the slowest fit's
steps, whatever the number of fits, and each step reads the frame once.

Starts: k-means++ and Lloyd steps on one random sample of at most ``START_ROWS`` rows,
drawn from all partitions alike, one task per fit.  From there every step reads all rows, until
the centers rest; the nearer the start, the fewer passes over the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import _log_density
from .partials import batch_sums, task_count

START_ROWS = 16_384
SAME_DRAWS = 8  # draws of mini-batches before they grow
RUNGS = (4, 8, 16, 32)  # steps after which the worse half of a race drops out


@dataclass
class Fit:
    """One model over the columns ``at`` of a frame; ``race`` names the fits of which only the best counts."""
    at: tuple[int, ...]
    k: int
    seed: int
    race: object = None
    covariance: str | None = None  # ``full`` or ``diag`` for a mixture
    centers: np.ndarray | None = None
    weights: np.ndarray | None = None
    covariances: np.ndarray | None = None
    cost: float = math.inf  # sum of squared distances to the centers
    mean_ll: float = -math.inf
    n_iter: int = 0
    dropped_at: int | None = None

    def state(self) -> tuple:
        return self.at, self.centers, self.weights, self.covariances


def _distances(X: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.zeros((len(X), len(centers)))
    for j in range(centers.shape[1]):
        out += (X[:, j, None] - centers[None, :, j]) ** 2
    return out


def _nearest(X: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, squared distance) of the nearest center, ties to the first; center by center over whole columns."""
    columns, label, best = np.ascontiguousarray(X.T), np.zeros(len(X), dtype=np.intp), None
    for i, center in enumerate(centers):
        d2 = np.zeros(len(X))
        for x, c in zip(columns, center):
            x = x - c
            x *= x
            d2 += x
        if best is None:
            best = d2
        else:
            label[d2 < best] = i
            np.minimum(best, d2, out=best)
    return label, best


def _cluster_sums(X: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(label, minlength=k).astype(float)
    return count, np.stack([np.bincount(label, weights=X[:, j], minlength=k) for j in range(X.shape[1])], axis=1)


# ---------------------------------------------------------------------------
# Starts
# ---------------------------------------------------------------------------
def start_sample(df: DataFrame, cols: list[str], n_rows: int, seed: int, rows: int = START_ROWS) -> np.ndarray:
    """At most ``rows`` random rows, every partition drawn from alike; all rows of a smaller table."""
    found = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).withColumn("_u", F.rand(seed))
    share = 1.5 * rows / max(n_rows, 1)
    if share < 1:
        found = found.filter(F.col("_u") < share)
    found = found.orderBy("_u").limit(rows).toPandas().sort_values("_u")
    return found[cols].to_numpy(dtype=float)


def plus_plus(X: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++: each further center is drawn with the squared distance to the nearest one as weight."""
    centers = [X[rng.integers(len(X))]]
    near = ((X - centers[0]) ** 2).sum(axis=1)
    while len(centers) < k:
        total = near.sum()
        at = rng.choice(len(X), p=near / total) if total > 0 else rng.integers(len(X))
        centers.append(X[at])
        near = np.minimum(near, ((X - X[at]) ** 2).sum(axis=1))
    return np.array(centers)


def _lloyd(X: np.ndarray, centers: np.ndarray, tol: float, max_iter: int) -> np.ndarray:
    for _ in range(max_iter):
        count, total = _cluster_sums(X, _distances(X, centers).argmin(axis=1), len(centers))
        moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
        shift = ((moved - centers) ** 2).sum()
        centers = moved
        if shift <= tol:
            break
    return centers


def _start(sample: np.ndarray, fit: Fit, rel_tol: float, lloyd: bool) -> np.ndarray:
    X = sample[:, list(fit.at)]
    centers = plus_plus(X, fit.k, np.random.default_rng([fit.seed, fit.k]))
    return _lloyd(X, centers, rel_tol * X.var(axis=0).mean(), 100) if lloyd else centers


def start_kmeans(spark: SparkSession, sample: np.ndarray, fits: list[Fit], rel_tol: float = 1e-4, lloyd: bool = True) -> None:
    """Start centers of each fit: its own k-means++ draw, and Lloyd steps on the sample; a task per fit."""
    for fit in fits:
        if len(sample) < fit.k:
            raise ValueError(f"{len(sample)} rows cannot make {fit.k} clusters")
    if not fits:
        return
    sent = spark.sparkContext.broadcast((sample, fits))

    def run(batches):
        for pdf in batches:
            found = [(int(i), _start(sent.value[0], sent.value[1][i], rel_tol, lloyd).ravel().tolist()) for i in pdf["id"]]
            yield pd.DataFrame(found, columns=["id", "centers"])
    tasks = min(len(fits), max(1, spark.sparkContext.defaultParallelism))
    for r in spark.range(0, len(fits), 1, tasks).mapInPandas(run, "id long, centers array<double>").collect():
        fits[r.id].centers = np.array(r.centers).reshape(fits[r.id].k, -1)
    sent.unpersist()


# ---------------------------------------------------------------------------
# k-means
# ---------------------------------------------------------------------------
def _kmeans_part(X, states):
    out = []
    for at, centers, *_ in states:
        own = X[:, at]
        label, d2 = _nearest(own, centers)
        count, total = _cluster_sums(own, label, len(centers))
        out += [count, total.ravel(), [d2.sum()]]
    return np.concatenate(out)


def fit_kmeans(df: DataFrame, cols: list[str], fits: list[Fit], variances: np.ndarray, max_iter: int = 300,
               rel_tol: float = 1e-4) -> list[Fit]:
    """K1 for all ``fits`` at once: Lloyd steps over all rows until the centers' squared shifts add up to at most
    ``rel_tol`` times the mean variance of the fit's columns.  ``cost`` is that of the centers returned."""
    tasks, running, last = task_count(df), list(fits), set()
    while running:
        states = [f.state() for f in running]
        length = sum(f.k * (1 + len(f.at)) + 1 for f in running)
        sums, at, still = batch_sums(df, cols, _kmeans_part, length, states, tasks), 0, []
        for f in running:
            d = len(f.at)
            own, at = sums[at:at + f.k * (1 + d) + 1], at + f.k * (1 + d) + 1
            f.cost = float(own[-1])
            if id(f) in last:  # the last pass was for the cost of the final centers
                continue
            count, total = own[:f.k], own[f.k:-1].reshape(f.k, d)
            moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], f.centers)
            shift = float(((moved - f.centers) ** 2).sum())
            f.centers, f.n_iter = moved, f.n_iter + 1
            if shift <= rel_tol * float(np.mean(variances[list(f.at)])) or f.n_iter >= max_iter:
                last.add(id(f))
            still.append(f)
        running = still
    return fits


def best_of(fits: list[Fit]) -> dict:
    """The fit of least cost, or of greatest likelihood, of each race (ties to the first)."""
    out: dict = {}
    for f in fits:
        now = out.get(f.race)
        if now is None or (f.mean_ll > now.mean_ll if f.covariance else f.cost < now.cost):
            out[f.race] = f
    return out


# ---------------------------------------------------------------------------
# Mixtures
# ---------------------------------------------------------------------------
def _em_part(X, states):
    out = []
    for at, means, weights, covariances in states:
        own = X[:, at]
        logp = _log_density(own, weights, means, covariances)
        top = logp.max(axis=1, keepdims=True)
        lse = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
        r = np.exp(logp - lse[:, None])
        squares = (own[:, :, None] * own[:, None, :]).reshape(len(own), -1)
        out += [r.sum(axis=0), (r.T @ own).ravel(), (r.T @ squares).ravel(), [lse.sum()]]
    return np.concatenate(out)


def fit_mixtures(df: DataFrame, cols: list[str], fits: list[Fit], n_rows: int, variances: np.ndarray, max_iter: int = 100,
                 tol: float = 1e-3, reg_covar: float = 1e-4, rungs: tuple[int, ...] = RUNGS) -> list[Fit]:
    """K3 / K4 for all ``fits`` at once: EM from the fits' centers, starts raced by successive halving.

    After each of ``rungs`` steps the worse half of a race's starts, by likelihood, drops out; a start
    ends when its mean log-likelihood per row changes by less than ``tol``.  See ``best_of``.
    """
    tasks = task_count(df)
    for f in fits:
        d = len(f.at)
        f.weights = np.full(f.k, 1.0 / f.k)
        f.covariances = np.array([np.diag(variances[list(f.at)] / f.k + reg_covar)] * f.k).reshape(f.k, d, d)
    running, step = list(fits), 0
    while running:
        length = sum(f.k * (1 + len(f.at) + len(f.at) ** 2) + 1 for f in running)
        sums, at, still = batch_sums(df, cols, _em_part, length, [f.state() for f in running], tasks), 0, []
        for f in running:
            d = len(f.at)
            size = f.k * (1 + d + d * d) + 1
            own, at = sums[at:at + size], at + size
            before, f.mean_ll = f.mean_ll, float(own[-1]) / max(n_rows, 1)
            if abs(f.mean_ll - before) < tol or f.n_iter >= max_iter:
                continue
            r = np.maximum(own[:f.k], 1e-12)
            f.weights, f.centers = r / r.sum(), own[f.k:f.k * (1 + d)].reshape(f.k, d) / r[:, None]
            second = own[f.k * (1 + d):-1].reshape(f.k, d, d) / r[:, None, None]
            f.covariances = second - f.centers[:, :, None] * f.centers[:, None, :]
            if f.covariance == "diag":
                f.covariances = f.covariances * np.eye(d)
            f.covariances = f.covariances + reg_covar * np.eye(d)
            f.n_iter += 1
            still.append(f)
        step += 1
        if step in rungs:
            for race in {f.race for f in still}:
                left = sorted((f for f in fits if f.race == race and f.dropped_at is None), key=lambda f: -f.mean_ll)
                for f in left[(len(left) + 1) // 2:]:
                    f.dropped_at = step
        running = [f for f in still if f.dropped_at is None]
    return fits


# ---------------------------------------------------------------------------
# Mini-batch k-means
# ---------------------------------------------------------------------------
_MINI = "fit int, centers array<double>, seen array<double>, smoothed double, best double, stall int, done int, over boolean"


def draw_batches(df: DataFrame, cols: list[str], share: float, fits: list[int], draw: int) -> DataFrame:
    """(cols, _fit, _u): rows drawn with replacement from all partitions alike, for each fit in a random order ``_u``."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).sample(True, share, 977 * draw + 11)
    return rows.withColumn("_fit", F.explode(F.array(*[F.lit(i) for i in fits]))).withColumn("_u", F.rand(draw + 5))


def fit_minibatch(df: DataFrame, cols: list[str], fits: list[Fit], n_rows: int, batch_size: int = 1024, max_passes: int = 200,
                  max_no_improvement: int = 10, batches_per_draw: int = 32) -> list[Fit]:
    """K2 for all ``fits`` at once, ``batches_per_draw`` batches a job.

    One scan draws rows with replacement, the same share of every partition; each fit puts them in a random order
    of its own, and a task folds a fit's batches as they come in that order, holding one batch at a time.  The first ``SAME_DRAWS``
    draws are of some 32 x 1024 rows each; from then on each is twice the one before, up to the table's size, so
    the number of jobs grows with the logarithm of the batches that a large table's smoothing takes.
    A batch moves each center towards the batch's mean by ``rows of the batch / rows seen``.  A fit ends when the
    smoothed batch inertia has not improved for ``max_no_improvement`` batches.
    """
    most = max(1, max_passes * n_rows // batch_size)
    alpha = min(1.0, batch_size * 2.0 / (n_rows + 1))
    states = {i: {"centers": f.centers, "seen": np.zeros(f.k), "smoothed": None, "best": None, "stall": 0, "done": 0}
              for i, f in enumerate(fits)}
    running, draw = list(states), 0
    while running:
        batches = min(batches_per_draw << max(0, draw + 1 - SAME_DRAWS), max(batches_per_draw, n_rows // batch_size))
        share = batches * batch_size / max(n_rows, 1)
        sent = df.sparkSession.sparkContext.broadcast(({i: states[i] for i in running}, {i: len(fits[i].at) for i in running}))

        def step(now: dict, batch: np.ndarray) -> None:
            centers, seen = now["centers"], now["seen"]
            d2 = _distances(batch, centers)
            count, total = _cluster_sums(batch, d2.argmin(axis=1), len(centers))
            hit = count > 0
            seen += count
            centers[hit] += (count / np.maximum(seen, 1))[hit, None] * (total[hit] / count[hit, None] - centers[hit])
            inertia = float(d2.min(axis=1).mean())
            smoothed = inertia if now["smoothed"] is None else now["smoothed"] * (1 - alpha) + inertia * alpha
            better = now["best"] is None or smoothed < now["best"]
            now |= {"smoothed": smoothed, "best": smoothed if better else now["best"], "stall": 0 if better else now["stall"] + 1,
                    "done": now["done"] + 1}
            now["over"] = now["stall"] >= max_no_improvement or now["done"] >= most

        def ended(now: dict, rest: np.ndarray) -> pd.DataFrame:
            if len(rest) and not now["over"]:
                step(now, rest)
            return pd.DataFrame([{**now, "centers": now["centers"].ravel().tolist(), "seen": now["seen"].tolist()}])[
                ["fit", "centers", "seen", "smoothed", "best", "stall", "done", "over"]]

        def fold(parts):
            now, rest = None, None
            for pdf in parts:
                for i, own in pdf.groupby("_fit"):
                    if now is None or now["fit"] != i:
                        if now is not None:
                            yield ended(now, rest)
                        old = sent.value[0][i]
                        now = {**old, "fit": i, "over": False, "centers": old["centers"].copy(), "seen": old["seen"].copy()}
                        rest = np.empty((0, sent.value[1][i]))
                    if now["over"]:
                        continue
                    rest = np.concatenate([rest, own[[f"_x{j}" for j in range(rest.shape[1])]].to_numpy(dtype=float)])
                    while len(rest) >= batch_size and not now["over"]:
                        step(now, rest[:batch_size])
                        rest = rest[batch_size:]
            if now is not None:
                yield ended(now, rest)

        # only a fit's own columns travel; a task may get two fits, one after the other
        own = [F.coalesce(*[F.when(F.col("_fit") == i, F.col(cols[fits[i].at[j]])) for i in running if j < len(fits[i].at)]).alias(f"_x{j}")
               for j in range(max(len(fits[i].at) for i in running))]
        drawn = draw_batches(df, cols, share, running, draw).select("_fit", "_u", *own)
        found = drawn.repartition(2 * len(running), "_fit").sortWithinPartitions("_fit", "_u").mapInPandas(fold, _MINI).collect()  # one row per fit
        for r in found:
            states[r.fit] = {"centers": np.array(r.centers).reshape(fits[r.fit].k, -1), "seen": np.array(r.seen),
                             "smoothed": r.smoothed, "best": r.best, "stall": r.stall, "done": r.done}
            if r.over:
                running.remove(r.fit)
        sent.unpersist()
        draw += 1
        if draw > max_passes * n_rows // max(1, batches_per_draw * batch_size) + 10:
            break
    for i, f in enumerate(fits):
        f.centers, f.n_iter = states[i]["centers"], states[i]["done"]
    return fits


def column_variances(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Population variances in one aggregate; a null or NaN among the features is an error."""
    bad = sum(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in cols)
    row = df.agg(bad, *[F.var_pop(c) for c in cols]).first()
    if row[0]:
        raise ValueError(f"{row[0]} features without a number")
    return np.array([float(v or 0.0) for v in row[1:]])


def elbow_sweep(df: DataFrame, cols: list[str], ks, n_init: int, n_rows: int, seed: int) -> list[tuple[int, float, float | None]]:
    """(k, inertia, squared silhouette) for every k; all (k, seed) fits share their passes, all rows in each."""
    fits = [Fit(tuple(range(len(cols))), k, seed + i, race=k) for k in ks for i in range(n_init)]
    variances = column_variances(df, cols)
    start_kmeans(df.sparkSession, start_sample(df, cols, n_rows, seed), fits)
    best = best_of(fit_kmeans(df, cols, fits, variances))
    found = qualities(df, cols, [best[k] for k in ks])
    return [(k, best[k].cost, q.silhouette) for k, q in zip(ks, found)]


# ---------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------
@dataclass
class Quality:
    """Of one fit over all rows: inertia, squared silhouette, Davies-Bouldin, Calinski-Harabasz, rows per cluster."""
    inertia: float
    silhouette: float | None
    davies: float | None
    calinski: float | None
    sizes: list[int]


def _labels(own: np.ndarray, centers, weights, covariances) -> np.ndarray:
    if weights is None:
        return _distances(own, centers).argmin(axis=1)
    return _log_density(own, weights, centers, covariances).argmax(axis=1)


def _moment_part(X, states):
    """Per fit: rows, sums and squared lengths by cluster, and squared distances to the centers."""
    out = []
    for at, centers, weights, covariances in states:
        own = X[:, at]
        label = _labels(own, centers, weights, covariances)
        count, total = _cluster_sums(own, label, len(centers))
        squares = np.bincount(label, weights=(own ** 2).sum(axis=1), minlength=len(centers))
        out += [count, total.ravel(), squares, [((own - centers[label]) ** 2).sum()]]
    return np.concatenate(out)


def _quality_part(X, states):
    """Per fit: the rows' silhouettes, and by cluster the distances and squared distances to the cluster's mean."""
    out = []
    for at, centers, weights, covariances, count, means, squares in states:
        own = X[:, at]
        label = _labels(own, centers, weights, covariances)
        # mean squared distance to cluster C: |x|^2 - 2 x.mean_C + mean |y|^2, which is |x - mean_C|^2 + its variance
        mean_d2 = _distances(own, means) + np.maximum(squares - (means ** 2).sum(axis=1), 0)[None, :]
        mean_d2[:, count == 0] = np.inf
        at_own = np.arange(len(own)), label
        n = count[label]
        a = np.where(n > 1, mean_d2[at_own] * n / np.maximum(n - 1, 1), 0.0)
        mean_d2[at_own] = np.inf
        b = mean_d2.min(axis=1)
        top = np.maximum(a, b)
        silhouette = np.where((n > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
        d2 = ((own - means[label]) ** 2).sum(axis=1)
        k = len(centers)
        out += [[silhouette.sum()], np.bincount(label, weights=np.sqrt(d2), minlength=k), np.bincount(label, weights=d2, minlength=k)]
    return np.concatenate(out)


def qualities(df: DataFrame, cols: list[str], fits: list[Fit]) -> list[Quality]:
    """K7, K8 (squared), K9, K10 of all ``fits`` in two passes over the frame; None where fewer than two clusters have rows."""
    tasks, states = task_count(df), [f.state() for f in fits]
    sums = batch_sums(df, cols, _moment_part, sum(f.k * (2 + len(f.at)) + 1 for f in fits), states, tasks)
    at, moments, costs = 0, [], []
    for f in fits:
        d = len(f.at)
        own, at = sums[at:at + f.k * (2 + d) + 1], at + f.k * (2 + d) + 1
        n = np.maximum(own[:f.k], 1)
        moments.append((own[:f.k], own[f.k:f.k * (1 + d)].reshape(f.k, d) / n[:, None], own[f.k * (1 + d):-1] / n))
        costs.append(float(own[-1]))
    sums = batch_sums(df, cols, _quality_part, sum(1 + 2 * f.k for f in fits), [(*s, *m) for s, m in zip(states, moments)], tasks)
    at, out = 0, []
    for f, (count, means, _), cost in zip(fits, moments, costs):
        own, at = sums[at:at + 1 + 2 * f.k], at + 1 + 2 * f.k
        sizes, has = [int(c) for c in count], count > 0
        rows, k = int(count.sum()), int(has.sum())
        if k < 2:
            out.append(Quality(cost, None, None, None, sizes))
            continue
        mean, spread, within = means[has], own[1:1 + f.k][has] / count[has], float(own[1 + f.k:].sum())
        gap = np.sqrt(((mean[:, None, :] - mean[None, :, :]) ** 2).sum(axis=2))
        ratio = np.where(gap > 0, (spread[:, None] + spread[None, :]) / np.where(gap > 0, gap, 1), 0.0)
        np.fill_diagonal(ratio, -np.inf)
        center = (count[has, None] * mean).sum(axis=0) / rows
        between = float((count[has] * ((mean - center) ** 2).sum(axis=1)).sum())
        calinski = 1.0 if within == 0 else between * (rows - k) / (within * (k - 1)) if rows > k else None
        out.append(Quality(cost, float(own[0]) / rows, float(ratio.max(axis=1).mean()), calinski, sizes))
    return out
