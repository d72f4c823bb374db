"""The training job: validate -> derive -> candidate grid -> k sweep -> model of the best candidate ->
metrics -> naming -> bands -> statistics -> sinks.

Every fit and every metric reads the whole table.  The validated table is persisted
once, and so are the scaled features of all scalers, side by side; all fits of the
grid share their passes over them, as do all fits of the sweep.  The best candidate's own fit, whatever its
variant and scaler, is the model that is named, stored and reported.
"""

from __future__ import annotations

import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import cluster as K
from ..operators import evaluate as EV
from ..operators import multifit as MF
from ..operators import naming as NM
from ..operators import reports as R
from ..operators import scaling as SC
from ..operators import scoring as SCO
from ..operators import validate as V
from ..operators.partials import spread
from ..sinks import writers as W
from ..sources import adapter


#: What makes a cell of the grid a failed candidate; anything else, such as a lost executor, ends the run.
FIT_ERRORS = (ValueError, ArithmeticError, np.linalg.LinAlgError)


@dataclass
class TrainConfig:
    model_variants: list[str] = field(default_factory=lambda: ["kmeans"])
    preprocessors: list[str] = field(default_factory=lambda: ["standard"])
    feature_sets: list[list[str]] = field(default_factory=lambda: [list(S.FEATURES)])
    final_k: int = S.FINAL_K
    k_range: list[int] = field(default_factory=lambda: list(S.K_RANGE))
    n_init_final: int = S.KMEANS_FINAL_N_INIT
    n_init_search: int = S.KMEANS_SEARCH_N_INIT
    sweep: bool = True


@dataclass
class Candidate:
    variant: str
    preprocessor: str
    features: list[str]
    silhouette: float | None = None
    davies: float | None = None
    calinski: float | None = None
    inertia: float | None = None
    aic: float | None = None
    bic: float | None = None
    error: str | None = None
    n_iter: int = 0
    scaler: object = None
    centers: list | None = None  # in scaled units: k-means centers or mixture means
    mixture: K.MixtureFit | None = None

    def key(self):
        """H3: silhouette up, Davies-Bouldin down, Calinski-Harabasz up (6 dp)."""
        return (round(self.silhouette, 6), -round(self.davies, 6), round(self.calinski, 6))

    def record(self) -> dict:
        r4 = lambda v, d: None if v is None else round(float(v), d)
        return {"variant": self.variant, "preprocessor": self.preprocessor, "features": self.features,
                "silhouette": r4(self.silhouette, 4), "davies": r4(self.davies, 4),
                "calinski": r4(self.calinski, 1), "inertia": r4(self.inertia, 1),
                "aic": r4(self.aic, 2), "bic": r4(self.bic, 2), "error": self.error}


@dataclass
class TrainResult:
    model: SCO.SegmentModel
    segmented: DataFrame
    stats: DataFrame
    candidates: list[Candidate]
    sweep: list[tuple[int, float, float]]
    best_k: int | None
    metrics: dict
    rows: int
    columns: int
    out_dir: str
    phases: dict = field(default_factory=dict)


def fit_preprocessor(kind: str, df: DataFrame, features: list[str], n_rows: int):
    fits = {"standard": SC.fit_standard, "robust": SC.fit_robust, "power_yeo_johnson": SC.fit_yeo_johnson,
            "quantile_normal": SC.fit_quantile_normal}
    if kind not in fits:
        raise ValueError(f"no preprocessor named {kind}")
    return fits[kind](df, features)


def scaled_frame(df: DataFrame, scaler) -> DataFrame:
    """The scaled features and their vector, persisted (the caller releases it)."""
    zcols = [f"z_{f}" for f in scaler.features]
    return K.vectors(scaler.transform(df).select(*zcols), zcols).persist(StorageLevel.MEMORY_AND_DISK)


def joint_frame(df: DataFrame, scalers: list, n_rows: int) -> tuple[DataFrame, list[str], list[tuple[int, ...]]]:
    """The scaled features of all ``scalers`` side by side, spread over all cores and persisted, and which columns are whose."""
    out, cols, at = df, [], []
    for i, scaler in enumerate(scalers):
        names = {f"z_{f}": f"s{i}_{f}" for f in scaler.features}
        out = scaler.transform(out).withColumnsRenamed(names)
        at.append(tuple(range(len(cols), len(cols) + len(names))))
        cols += names.values()
    return spread(out.select(*cols), n_rows).persist(StorageLevel.MEMORY_AND_DISK), cols, at


def _fits_of(variant: str, key, at: tuple[int, ...], cfg: TrainConfig) -> list[MF.Fit]:
    starts = {"kmeans": cfg.n_init_final, "minibatch_kmeans": max(1, cfg.n_init_final // 2),
              "gaussian_mixture_full": max(2, cfg.n_init_final // 2), "gaussian_mixture_diag": max(2, cfg.n_init_final // 2)}
    if variant not in starts:
        raise ValueError(f"no model variant named {variant}")
    covariance = variant.rsplit("_", 1)[1] if variant.startswith("gaussian") else None
    return [MF.Fit(at, cfg.final_k, seed, race=key, covariance=covariance) for seed in K.seeds_for(starts[variant])]


def evaluate_grid(df: DataFrame, n_rows: int, cfg: TrainConfig) -> list[Candidate]:
    """Every (variant, preprocessor, features) candidate, in grid order.

    All scalers' features lie side by side in one persisted frame, and all candidates'
    starts step together (``multifit``): k-means, mini-batch and mixtures are three
    loops that run at once, and two passes give every candidate's metrics.
    A cell whose scaler or start cannot be fitted keeps the reason; Spark's errors are raised.
    """
    cells = [(p, tuple(f)) for p in cfg.preprocessors for f in cfg.feature_sets]
    found: dict[tuple, Candidate] = {}
    scalers: dict[tuple, object] = {}
    for prep, feats in cells:
        try:
            scalers[prep, feats] = fit_preprocessor(prep, df, list(feats), n_rows)
        except FIT_ERRORS as exc:
            found |= {(v, prep, feats): Candidate(v, prep, list(feats), error=str(exc)) for v in cfg.model_variants}
    if scalers:
        frame, cols, at = joint_frame(df, list(scalers.values()), n_rows)
        variances = MF.column_variances(frame, cols)
        sample = MF.start_sample(frame, cols, n_rows, S.SAMPLE_SEED)
        loops: dict[str, list[MF.Fit]] = {"kmeans": [], "minibatch": [], "mixture": []}
        for variant in cfg.model_variants:
            for (prep, feats), own in zip(scalers, at):
                key = (variant, prep, feats)
                loop = "mixture" if variant.startswith("gaussian") else "minibatch" if variant.startswith("mini") else "kmeans"
                try:
                    loops[loop] += _fits_of(variant, key, own, cfg)
                except FIT_ERRORS as exc:
                    found[key] = Candidate(variant, prep, list(feats), error=str(exc))
        if len(sample) < cfg.final_k:  # no candidate can be started
            reason = f"{len(sample)} rows cannot make {cfg.final_k} clusters"
            found |= {f.race: Candidate(f.race[0], f.race[1], list(f.race[2]), error=reason) for own in loops.values() for f in own}
            loops = {k: [] for k in loops}
        MF.start_kmeans(df.sparkSession, sample, loops["kmeans"] + loops["mixture"])
        MF.start_kmeans(df.sparkSession, sample, loops["minibatch"], lloyd=False)
        work = [lambda: MF.fit_kmeans(frame, cols, loops["kmeans"], variances),
                lambda: MF.fit_minibatch(frame, cols, loops["minibatch"], n_rows),
                lambda: MF.fit_mixtures(frame, cols, loops["mixture"], n_rows, variances)]
        with ThreadPoolExecutor(max_workers=len(work)) as pool:
            for f in [pool.submit(w) for w in work]:
                f.result()
        mini = loops["minibatch"]
        for fit, quality in zip(mini, MF.qualities(frame, cols, mini) if mini else []):
            fit.cost = quality.inertia
        best = {k: f for fits in loops.values() for k, f in MF.best_of(fits).items()}
        for (key, fit), quality in zip(best.items(), MF.qualities(frame, cols, list(best.values())) if best else []):
            found[key] = _candidate(key, scalers[key[1:]], fit, quality, n_rows)
        frame.unpersist()
    return [found[v, p, tuple(f)] for v in cfg.model_variants for p in cfg.preprocessors for f in cfg.feature_sets]


def _candidate(key: tuple, scaler, fit: MF.Fit, quality: MF.Quality, n_rows: int) -> Candidate:
    variant, prep, feats = key
    cand = Candidate(variant, prep, list(feats), quality.silhouette, quality.davies, quality.calinski,
                     n_iter=fit.n_iter, scaler=scaler, centers=fit.centers.tolist())
    if None in (quality.silhouette, quality.davies, quality.calinski):
        cand.error = "fewer than two clusters, or not more rows than clusters"
    if fit.covariance is None:
        cand.inertia = fit.cost
    else:
        cand.mixture = K.MixtureFit(fit.weights.tolist(), fit.centers.tolist(), fit.covariances.tolist(), fit.mean_ll, fit.n_iter, n_rows)
        cand.aic, cand.bic = EV.aic_bic(fit.mean_ll * n_rows, n_rows, fit.k, len(fit.at), fit.covariance)
    return cand


def model_of(cand: Candidate) -> SCO.SegmentModel:
    """J5 + K14: the candidate's centers in original units, named, with all that scoring needs."""
    centers = [cand.scaler.inverse(c) for c in cand.centers]
    at = {f: i for i, f in enumerate(cand.features)}
    names = NM.greedy_names([(c[at[S.INCOME]], c[at[S.SCORE]]) for c in centers])
    return SCO.SegmentModel(cand.scaler, centers, names, cand.variant, cand.n_iter, cand.inertia, cand.centers, cand.mixture)


def train(spark: SparkSession, raw: DataFrame, label: str, data_path: str, out_dir: str,
          cfg: TrainConfig | None = None, history_dir: str | None = None) -> TrainResult:
    """Train from a raw (all-text) customer table: fail-fast validation first.

    ``history_dir``: the run history that the runs of several ``out_dir`` share.
    """
    summary = V.summary(raw).first()
    if summary["message"] is not None:
        raise V.ValidationError(summary["message"])
    return train_validated(spark, V.typed(V.normalize(raw)), int(summary["total_rows"]), label, data_path,
                           out_dir, cfg, history_dir)


def train_validated(spark: SparkSession, typed: DataFrame, n_rows: int, label: str, data_path: str,
                    out_dir: str, cfg: TrainConfig | None = None, history_dir: str | None = None) -> TrainResult:
    cfg = cfg or TrainConfig()
    phases: dict[str, float] = {}
    clock = [time.perf_counter()]

    def mark(name: str) -> None:
        now = time.perf_counter()
        phases[name] = round(now - clock[0], 3)
        clock[0] = now

    df = typed.withColumn("gender_enc", (F.col(S.GENDER) == "Female").cast("int"))
    df = df.persist(StorageLevel.MEMORY_AND_DISK)

    # ---- K12 candidate grid, H3 best ----
    candidates = evaluate_grid(df, n_rows, cfg)
    ok = [c for c in candidates if c.error is None]
    if not ok:
        raise RuntimeError("no candidate could be fitted: " + "; ".join(sorted({c.error for c in candidates})))
    best = max(ok, key=Candidate.key)  # max keeps the first of equal keys
    mark("candidates")

    # ---- K13 sweep, H4 best k ----
    sweep = []
    if cfg.sweep:
        frame, cols, _ = joint_frame(df, [best.scaler], n_rows)
        sweep = MF.elbow_sweep(frame, cols, cfg.k_range, cfg.n_init_search, n_rows, S.SAMPLE_SEED)
        frame.unpersist()
    bk = K.best_k(sweep) if sweep else None
    mark("sweep")

    # ---- the best candidate's fit is the model ----
    model = model_of(best)
    scored = SCO.score(df, model)  # K15/F1: cluster, segment, distance, confidence
    metrics = {
        "silhouette": best.silhouette, "davies": best.davies, "calinski": best.calinski,
        "inertia": best.inertia, "aic": best.aic, "bic": best.bic, "n_iter": best.n_iter,
        "model_variant": model.variant, "preprocessor_variant": best.preprocessor, "features": best.features,
        "best_k": bk, "final_k": cfg.final_k,
    }
    mark("model")

    segmented = adapter.with_derived(scored.drop("d2", "dist", "confidence"))
    centers = {model.segment_map[i]: (c[0], c[1]) for i, c in enumerate(model.centers)}

    # ---- sinks ----
    doc = {k: (round(float(v), {"silhouette": 4, "davies": 3, "calinski": 1, "inertia": 1}.get(k, 6))
               if isinstance(v, float) else v) for k, v in metrics.items()}
    doc["candidate_results"] = [c.record() for c in candidates]
    writes = [
        lambda: W.write_table(segmented, f"{out_dir}/segmented"),
        lambda: W.write_required(segmented, f"{out_dir}/current_dataset_csv"),
        lambda: W.save_model(spark, model, f"{out_dir}/model"),
        lambda: W.write_document(spark, doc, W.METRICS_SCHEMA, f"{out_dir}/model_metrics"),
        lambda: W.write_document(spark, {"features": best.features, "variant": best.variant,
                                         "preprocessor": best.preprocessor}, W.FEATURES_SCHEMA,
                                 f"{out_dir}/selected_features"),
        lambda: W.append_run(spark, history_dir or f"{out_dir}/run_history", label, data_path, n_rows,
                             None if metrics["silhouette"] is None else round(float(metrics["silhouette"]), 4),
                             dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")),
    ]
    with ThreadPoolExecutor(max_workers=len(writes)) as pool:  # independent jobs, run concurrently
        for f in [pool.submit(w) for w in writes]:
            f.result()
    df.unpersist()
    segmented_read = spark.read.parquet(f"{out_dir}/segmented")
    stats = R.segment_stats(segmented_read, centers=centers, keys=("cluster", "segment"))
    mark("sinks")
    return TrainResult(model, segmented_read, stats, candidates, sweep, bk, metrics, n_rows,
                       len(segmented_read.columns), out_dir, phases)
