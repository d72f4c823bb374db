"""Training on planted clusters: sizes, metrics, naming, scoring, every grid cell, stored state."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.operators import cluster as K
from cohortlens.operators import evaluate as EV
from cohortlens.operators import scaling as SC
from cohortlens.operators import scoring as SCO
from cohortlens.plans import io_queries as Q
from cohortlens.plans import training as TR
from cohortlens.session import fresh_path
from cohortlens.operators import multifit as MF
from cohortlens.sinks import writers as W
from cohortlens.sources import files
from support import PLANTED, SF_SMALL, planted_rows


@pytest.fixture(scope="module")
def run(spark, planted_csv):
    raw = files.read_customer_csv(spark, planted_csv)
    history = fresh_path(spark, "test_history")
    runs = [TR.train(spark, raw, "planted", planted_csv, fresh_path(spark, "test_train"),
                     TR.TrainConfig(sweep=sweep, k_range=[3, 4, 5, 6]), history) for sweep in (False, True)]
    return runs[1], history


def test_planted_segments_are_found_and_named(run):
    r, _ = run
    assert r.rows == 200
    got = {row["segment"]: (row["n"], row["cx"], row["cy"]) for row in r.stats.collect()}
    for name, n, x, y in PLANTED:
        assert got[name][0] == n and abs(got[name][1] - x) < 2 and abs(got[name][2] - y) < 2
    assert abs(sum(x["pct"] for x in r.stats.collect()) - 100) < 0.5
    assert r.segmented.filter(F.col("segment").isNull()).count() == 0
    assert r.best_k == 5
    inertias = [i for _, i, _ in r.sweep]
    assert all(b <= a * 1.05 for a, b in zip(inertias, inertias[1:]))


def test_metrics_equal_numpy_over_all_rows(spark, run):
    r, _ = run
    rows = r.segmented.select("income_k", "score", "cluster").collect()
    X = np.array([[x["income_k"], x["score"]] for x in rows], float)
    X = (X - X.mean(axis=0)) / X.std(axis=0)
    lab = np.array([x["cluster"] for x in rows])
    centers = np.array([X[lab == j].mean(axis=0) for j in range(5)])
    within = sum(((X[lab == j] - centers[j]) ** 2).sum() for j in range(5))
    between = sum((lab == j).sum() * (centers[j] ** 2).sum() for j in range(5))
    assert abs(r.metrics["inertia"] - within) / within < 0.01
    assert abs(r.metrics["calinski"] - between * 195 / (within * 4)) / r.metrics["calinski"] < 0.01
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2))
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][lab == j].mean() for j in range(5) if j != lab[i])
        s.append((b - a) / max(a, b))
    z = spark.createDataFrame([(float(x), float(y), int(k)) for (x, y), k in zip(X, lab)], "x double, y double, l int")
    assert abs(EV.silhouette_exact(z, ["x", "y"], "l").first()[0] - float(np.mean(s))) < 1e-9


def test_silhouette_in_blocks_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 17), float((i * 7) % 23), i % 3) for i in range(300)], "a double, b double, l int")
    one = EV.silhouette_exact(df, ["a", "b"], "l").first()[0]
    monkeypatch.setattr(EV, "BLOCK_POINTS", 40)
    assert abs(EV.silhouette_exact(df, ["a", "b"], "l").first()[0] - one) < 1e-12


def test_silhouette_sums_are_one_row_per_point_and_label_whatever_the_blocks(spark, monkeypatch):
    """30 blocks: each point is in one of them, and its sums come out once per task's share of the right blocks."""
    rng = np.random.default_rng(3)
    X, weight, label = rng.normal(size=(600, 9)), rng.integers(1, 4, 600), rng.integers(0, 3, 600)
    points = spark.createDataFrame([(i, x.tolist(), int(m), int(c)) for i, (x, m, c) in enumerate(zip(X, weight, label))],
                                   "point long, x array<double>, m long, code long")
    monkeypatch.setattr(EV, "BLOCK_POINTS", 20)
    found = EV._label_sums(points)
    rows = found.groupBy("point", "code").agg(F.sum("d").alias("d"), F.count("*").alias("n")).collect()
    assert len(rows) == 1800 and max(r.n for r in rows) <= 3  # 30 right blocks by 16 a task, and a block at an end
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2)) * weight
    assert all(abs(r.d - d[r.point][label == r.code].sum()) < 1e-6 for r in rows)


def test_silhouette_of_more_labels_than_a_task_holds(spark):
    df = spark.createDataFrame([(float(i * i % 997), float(i % 31), i % 1100) for i in range(1300)], "a double, b double, l int")
    rows = [tuple(r) for r in df.collect()]
    X, lab = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
    d, size = np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2)), np.bincount(lab)
    sums = np.stack([np.bincount(lab, weights=row) for row in d])
    at = np.arange(1300), lab
    a, means = sums[at] / np.maximum(size[lab] - 1, 1), sums / size
    means[at] = np.inf
    b = means.min(axis=1)
    top = np.maximum(a, b)
    s = np.where((size[lab] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
    assert abs(EV.silhouette_exact(df, ["a", "b"], "l").first()[0] - s.mean()) < 1e-9


def test_scoring_examples(spark, run):
    r, _ = run
    req = spark.createDataFrame(
        [(33, "Female", 87.0, 82.0), (25, "Female", 26.0, 79.0), (41, "Male", 88.0, 17.0),
         (45, "Male", 26.0, 20.0), (38, "Female", 55.0, 50.0)],
        "age int, gender string, income_k double, score double")
    out = SCO.score(req, r.model).orderBy("age").collect()
    assert [x["segment"] for x in out] == [S.DISCOUNT, S.VIP, S.LOYAL, S.NEW, S.AT_RISK]
    assert all(0 <= x["confidence"] <= 100 for x in out)


def test_every_grid_cell_trains_and_stores_what_it_fitted(spark):
    rows = [(i, float(x), float(y)) for i, _, _, x, y in planted_rows()]
    df = spark.createDataFrame(rows, f"{S.CUSTOMER_ID} bigint, {S.INCOME} double, {S.SCORE} double").persist()
    cfg = TR.TrainConfig(model_variants=Q.GRID_VARIANTS, preprocessors=Q.GRID_PREPROCESSORS, n_init_final=2)
    cands = TR.evaluate_grid(df, len(rows), cfg)
    assert [(c.variant, c.preprocessor) for c in cands] == [(v, p) for v in Q.GRID_VARIANTS for p in Q.GRID_PREPROCESSORS]
    assert [c.error for c in cands] == [None] * 16
    for c in cands:
        model = SCO.SegmentModel.from_json(TR.model_of(c).to_json())
        assert model.variant == c.variant and (model.mixture is not None) == c.variant.startswith("gaussian")
        assert (c.aic is not None) == c.variant.startswith("gaussian")
        lab = SCO.score(df, model)
        assert lab.filter("segment is null").count() == 0 and lab.select("cluster").distinct().count() > 1
    df.unpersist()


def test_inverse_transforms(spark):
    df = spark.createDataFrame([(float(i), float((i * 37) % 101)) for i in range(200)], "income_k double, score double")
    for kind in Q.GRID_PREPROCESSORS:
        sc = TR.fit_preprocessor(kind, df, S.FEATURES, 200)
        row = sc.transform(df).filter("income_k = 60").first()
        x, y = sc.inverse([row["z_income_k"], row["z_score"]])
        assert abs(x - row["income_k"]) < 1 and abs(y - row["score"]) < 1.5
        assert SC.scaler_from_dict(sc.to_dict()).inverse([0.1, 0.2]) == sc.inverse([0.1, 0.2])


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.lognormal(0, 3, 500), np.repeat(2.5, 300), -rng.random(200)])
    df = spark.createDataFrame([(float(v), float(round(v))) for v in x], "income_k double, score double")
    got = SC.exact_quantiles(df, ["income_k", "score"], [0.0, 0.1, 0.25, 0.5, 0.77, 1.0], bins=16)
    assert np.allclose(got["income_k"], np.quantile(x, [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]), rtol=1e-12, atol=0)
    assert np.allclose(got["score"], np.quantile(np.round(x), [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]))


def test_mixture_finds_planted_weights(spark):
    df = spark.createDataFrame([(float(x), float(y)) for _, _, _, x, y in planted_rows()], "x double, y double").persist()
    own = MF.Fit((0, 1), 5, 0, covariance="full", centers=np.array([[x, y] for _, _, x, y in PLANTED], float))
    MF.fit_mixtures(df, ["x", "y"], [own], 200, MF.column_variances(df, ["x", "y"]))
    assert np.allclose(own.weights, [n / 200 for _, n, _, _ in PLANTED], atol=0.01)
    fit = K.MixtureFit(own.weights.tolist(), own.centers.tolist(), own.covariances.tolist(), own.mean_ll, own.n_iter, 200)
    row = K.mixture_log_likelihood(df, ["x", "y"], fit).first()
    assert abs(row["log_likelihood"] / row["n"] - fit.mean_ll) < 1e-9
    df.unpersist()


def test_stored_document_history_and_model(spark, run, tmp_path):
    r, history = run
    doc = W.read_document(spark, f"{r.out_dir}/model_metrics", W.METRICS_SCHEMA).first()
    assert doc["model_variant"] == "kmeans" and doc["preprocessor_variant"] == "standard" and len(doc["candidate_results"]) == 1
    assert doc["silhouette"] == round(r.metrics["silhouette"], 4)
    assert [(x["dataset_label"], x["rows"], x["runs"]) for x in W.latest_runs(spark, history).collect()] == [("planted", 200, 2)]
    model = W.load_model(spark, f"{r.out_dir}/model")
    SCO.check_compatible(model, r.model.features)
    assert model.segment_map == r.model.segment_map
    with pytest.raises(SCO.IncompatibleModel):
        SCO.check_compatible(SCO.SegmentModel(model.scaler, model.centers, {0: "x"}), r.model.features)
    (tmp_path / "doc.json").write_text('{\n  "silhouette": 0.5,\n  "features": ["a"]\n}\n')
    old = W.parse_documents(spark, str(tmp_path / "doc.json"), W.METRICS_SCHEMA, W.METRICS_DEFAULTS).collect()
    assert [(x["silhouette"], x["model_variant"], x["n_iter"], x["davies"]) for x in old] == [(0.5, "kmeans", 0, None)]


def test_publish_replaces_whole_versions(spark):
    base = fresh_path(spark, "publish")
    for n in (3, 5):
        W.publish(spark.range(n), base)
        assert spark.read.parquet(W.published(spark, base)).count() == n


def test_minibatch_kmeans_draws_from_every_partition(spark):
    """60,000 rows ordered by cluster: the last sixth is a cluster of its own."""
    df = spark.range(0, 60_000, 1, 12).select(
        (F.floor(F.col("id") / 10_000) * 10 + F.when(F.col("id") < 50_000, 0).otherwise(1000)
         + F.col("id") % 7 / 10).alias("x"), (F.col("id") % 5 / 10).alias("y")).persist()
    fits = [MF.Fit((0, 1), 6, seed) for seed in (42, 43, 44)]
    MF.start_kmeans(spark, MF.start_sample(df, ["x", "y"], 60_000, 1), fits, lloyd=False)
    MF.fit_minibatch(df, ["x", "y"], fits, 60_000)
    found = MF.qualities(df, ["x", "y"], fits)
    best = min(zip(found, fits), key=lambda x: x[0].inertia)[1]
    assert best.n_iter > 1 and min(abs(x - 1050.3) for x, _ in best.centers) < 1
    drawn = MF.draw_batches(df, ["x", "y"], 32 * 1024 / 60_000, [0, 1], 3).toPandas()
    for fit, own in drawn.groupby("_fit"):
        own = own.sort_values("_u")
        assert 31_000 < len(own) < 34_500
        parts = [own.iloc[a:a + 1024] for a in range(0, 31 * 1024, 1024)]
        assert all(0.1 < (p.x > 1000).mean() < 0.25 for p in parts)  # each batch is of the whole table
    df.unpersist()


def test_best_candidate_and_aic_bic_cover_the_whole_grid(spark, monkeypatch):
    """The best cell is the last of the grid: variant and scaler must both be tried."""
    asked = []

    def evaluate(df, n_rows, cfg):
        asked.append((cfg.model_variants, cfg.preprocessors))
        cells = [(v, p) for v in cfg.model_variants for p in cfg.preprocessors]
        return [TR.Candidate(v, p, S.FEATURES, 0.01 * i, 1.0, 1.0, None, *([1.0, 2.0] if "gauss" in v else [None, None]))
                for i, (v, p) in enumerate(cells)]

    monkeypatch.setattr(TR, "evaluate_grid", evaluate)
    best = Q.q_best_candidate(spark, SF_SMALL).collect()
    rows = Q.q_aic_bic(spark, SF_SMALL).collect()
    assert asked == [(Q.GRID_VARIANTS, Q.GRID_PREPROCESSORS)] * 2
    assert [(r.variant, r.preprocessor) for r in best] == [("gaussian_mixture_diag", "power_yeo_johnson")]
    assert len(rows) == 16 and sum(r.aic is not None for r in rows) == 8
