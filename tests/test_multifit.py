"""Many fits in shared passes: equal to separate fits, raced starts, metrics equal to the DataFrame forms."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import distance as D
from cohortlens.operators import cluster as K
from cohortlens.operators import evaluate as EV
from cohortlens.operators import multifit as MF
from support import planted_rows

XY = ["x", "y"]


@pytest.fixture(scope="module")
def points(spark):
    rows = [(float(x) + i % 7 / 10, float(y) - i % 5 / 10) for i, (_, _, _, x, y) in enumerate(planted_rows(3) * 3)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(5).persist()
    yield df, np.array(rows)
    df.unpersist()


def slow_lloyd(X, centers, tol):
    while True:
        label = ((X[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([X[label == j].mean(axis=0) if (label == j).any() else centers[j] for j in range(len(centers))])
        shift, centers = ((moved - centers) ** 2).sum(), moved
        if shift <= tol:
            return centers, ((X[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_fits_that_share_passes_equal_separate_fits(spark, points):
    df, X = points
    variances = MF.column_variances(df, XY)
    sample = X[:40]
    fits = [MF.Fit((0, 1), k, seed, race=k) for k in (2, 3, 5, 8) for seed in (1, 2, 3)]
    MF.start_kmeans(spark, sample, fits)
    starts = [f.centers.copy() for f in fits]
    MF.fit_kmeans(df, XY, fits, variances)
    for f, start in zip(fits, starts):
        centers, cost = slow_lloyd(X, start, 1e-4 * X.var(axis=0).mean())
        assert np.abs(f.centers - centers).max() < 1e-9 and abs(f.cost - cost) < 1e-6
        alone = MF.Fit((0, 1), f.k, f.seed, centers=start)
        MF.fit_kmeans(df, XY, [alone], variances)
        assert np.abs(alone.centers - f.centers).max() < 1e-9 and alone.n_iter == f.n_iter
    best = MF.best_of(fits)
    assert all(best[k].cost == min(f.cost for f in fits if f.k == k) for k in best)


def test_a_sweep_runs_as_many_jobs_as_its_slowest_fit_has_steps(points, monkeypatch):
    df, X = points
    calls = []
    whole = MF.batch_sums
    monkeypatch.setattr(MF, "batch_sums", lambda *a, **b: calls.append(1) or whole(*a, **b))
    rows = MF.elbow_sweep(df, XY, [2, 3, 4, 5, 6, 7], 4, len(X), 42)
    assert K.best_k(rows) == 5 and len(calls) < 30  # 24 fits
    assert all(b[1] <= a[1] for a, b in zip(rows, rows[1:]))


def test_metrics_of_many_fits_equal_the_separate_ones(spark, points):
    df, X = points
    fits = [MF.Fit((0, 1), k, 5) for k in (2, 5, 9)] + [MF.Fit((1,), 3, 5)]
    MF.start_kmeans(spark, X[::7], fits)
    mixture = MF.Fit((0, 1), 4, 5, covariance="full")
    MF.start_kmeans(spark, X[::7], [mixture])
    MF.fit_mixtures(df, XY, [mixture], len(X), MF.column_variances(df, XY))
    fit = K.MixtureFit(mixture.weights.tolist(), mixture.centers.tolist(), mixture.covariances.tolist(), 0.0, 0, 0)
    for f, q in zip([*fits, mixture], MF.qualities(df, XY, [*fits, mixture])):
        cols = [XY[i] for i in f.at]
        label = K.mixture_label(XY, fit) if f.covariance else D.nearest_index(D.distance_array(cols, f.centers.tolist()))
        lab = K.vectors(df.withColumn("prediction", label.cast("int")), cols)
        row = EV.dispersion(lab, cols, "prediction").first()
        assert abs(q.silhouette - EV.silhouette_squared(lab)) < 1e-9
        assert abs(q.davies - row["davies_bouldin"]) < 1e-9 and abs(q.calinski / row["calinski_harabasz"] - 1) < 1e-9
        sizes = {r.prediction: r["count"] for r in lab.groupBy("prediction").count().collect()}
        assert [sizes.get(j, 0) for j in range(f.k)] == q.sizes


def test_one_cluster_has_no_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    fits = [MF.Fit((0, 1), 2, 1)]
    MF.start_kmeans(spark, np.array([[1.0, 2.0]] * 5), fits)
    q = MF.qualities(df, XY, MF.fit_kmeans(df, XY, fits, MF.column_variances(df, XY)))[0]
    assert (q.inertia, q.silhouette, q.davies, q.calinski) == (0.0, None, None, None)
    with pytest.raises(ValueError):
        MF.start_kmeans(spark, np.array([[1.0, 2.0]]), fits)
    with pytest.raises(ValueError):
        MF.column_variances(df.withColumn("x", F.lit(None).cast("double")), XY)


def test_a_bad_start_loses_the_race(spark):
    """Three far groups; one start has two centers in one group and one between the others: a worse optimum."""
    rng = np.random.default_rng(4)
    middles = np.array([[0.0, 0.0], [30.0, 0.0], [30.0, 4.0]])
    X = np.concatenate([m + rng.normal(0, 0.5, (300, 2)) for m in middles])
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], "x double, y double").repartition(4).persist()
    variances = MF.column_variances(df, XY)

    def starts():
        bad = np.array([[-0.2, 0.0], [0.2, 0.0], [30.0, 2.0]])
        return [MF.Fit((0, 1), 3, i, covariance="diag", centers=c.copy())
                for i, c in enumerate([bad, bad + 0.05, middles + 0.3, bad - 0.05])]
    alone = starts()[:1]
    MF.fit_mixtures(df, XY, alone, len(X), variances)
    raced = MF.fit_mixtures(df, XY, starts(), len(X), variances, rungs=(2, 3))
    best = MF.best_of(raced)[None]
    assert best.seed == 2 and best.mean_ll > alone[0].mean_ll + 0.1
    assert sum(f.dropped_at is not None for f in raced) >= 1
    assert np.abs(np.sort(best.centers, axis=0) - np.sort(middles, axis=0)).max() < 0.2
    df.unpersist()


def test_a_frame_in_one_partition_is_spread_over_all_cores(spark, monkeypatch):
    from cohortlens.operators import partials
    from cohortlens.operators import scaling as SC
    from cohortlens.plans import training as TR
    df = spark.createDataFrame([(float(i % 50), float(i % 7)) for i in range(900)], "income_k double, score double").coalesce(1)
    scalers = [SC.fit_standard(df)]
    monkeypatch.setattr(partials, "TASK_ROWS", 100)
    frame, cols, _ = TR.joint_frame(df, scalers, 900)
    assert frame.rdd.getNumPartitions() >= 9 and frame.count() == 900
    frame.unpersist()
    monkeypatch.undo()
    frame, _, _ = TR.joint_frame(df, scalers, 900)  # a small table stays as it is
    assert frame.rdd.getNumPartitions() == 1
    frame.unpersist()


def test_nearest_and_mixture_sums_equal_plain_ones():
    rng = np.random.default_rng(1)
    X, centers = np.round(rng.normal(size=(500, 3)), 1), np.round(rng.normal(size=(4, 3)), 1)
    centers[2] = centers[1]  # ties go to the first
    label, d2 = MF._nearest(X, centers)
    assert (label == MF._distances(X, centers).argmin(axis=1)).all() and (d2 == MF._distances(X, centers).min(axis=1)).all()
    cov = np.array([np.eye(3) * 0.5 + 0.1 * i for i in range(1, 5)])
    weights = np.array([0.1, 0.2, 0.3, 0.4])
    diff = X[:, None] - centers[None]
    plain = np.log(weights) - 0.5 * (3 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + np.einsum("nki,kij,nkj->nk", diff, np.linalg.inv(cov), diff))
    assert np.allclose(K._log_density(X, weights, centers, cov), plain)
    r = np.exp(plain) / np.exp(plain).sum(axis=1, keepdims=True)
    own = MF._em_part(X, [((0, 1, 2), centers, weights, cov)])
    assert np.allclose(own, np.concatenate([r.sum(axis=0), (r.T @ X).ravel(), np.einsum("nk,ni,nj->kij", r, X, X).ravel(),
                                            [np.log(np.exp(plain).sum(axis=1)).sum()]]))


def test_mini_batch_jobs_grow_with_the_logarithm_of_the_batches(spark, monkeypatch):
    df = spark.range(0, 400_000, 1, 4).selectExpr("double(id % 3) * 10 + rand(1) AS x", "rand(2) AS y").persist()
    draws, whole = [], MF.draw_batches
    monkeypatch.setattr(MF, "draw_batches", lambda *a: draws.append(a[2]) or whole(*a))
    fits = [MF.Fit((0, 1), 3, 1), MF.Fit((0,), 3, 2)]  # fits of different columns share the draws
    MF.start_kmeans(spark, MF.start_sample(df, XY, 400_000, 1), fits, lloyd=False)
    MF.fit_minibatch(df, XY, fits, 400_000, batch_size=64, batches_per_draw=4)
    assert max(f.n_iter for f in fits) > 500 and len(draws) < 40  # four batches a draw would be over 125 draws
    assert max(draws) <= 1.01 and draws[0] == 4 * 64 / 400_000
    for f in fits:
        assert np.abs(np.sort(f.centers[:, 0]) - [0.5, 10.5, 20.5]).max() < 0.2
    df.unpersist()
