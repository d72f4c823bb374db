"""Source / sink round trips and the queries backed by a training run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import cluster as K
from ..operators import multifit as MF
from ..operators import evaluate as EV
from ..operators import lookups
from ..operators import scoring as SCO
from ..operators import scaling as SC
from ..operators import validate as V
from ..session import fresh_path
from ..sinks import writers as W
from ..sources import adapter, files
from .catalog import register
from . import training as TR
from .model_queries import _fixed_centers, q_label_ranking


# ---- A1 / B2 / B1 / B6 -----------------------------------------------------
@register("scan_customers")
def q_scan_customers(spark, sf_dir):
    """Write the raw customer table as header CSV, scan it back as text, quarantine-validate."""
    path = fresh_path(spark, "scan_customers")
    W.write_table(adapter.raw_customers(spark, sf_dir), path, fmt="csv")
    good, _bad = V.quarantine(files.read_customer_csv(spark, path))
    return good


@register("write_required_projection")
def q_write_required(spark, sf_dir):
    path = fresh_path(spark, "required_projection")
    W.write_required(adapter.customers(spark, sf_dir), path)
    return V.validate(files.read_customer_csv(spark, path))


@register("write_segmented")
def q_write_segmented(spark, sf_dir):
    path = fresh_path(spark, "segmented")
    for _ in range(2):  # the second write replaces the first by a new version
        W.publish(adapter.segmented(spark, sf_dir), path)
    return spark.read.parquet(W.published(spark, path))


SCATTER_COLS = [W.SEGMENTED_PUBLIC[c] for c in (*S.INTERNAL_COLUMNS, "cluster", "segment", "r_proxy", "f_proxy", "m_proxy")]
SCATTER_SCHEMA = ", ".join(f"`{c}` {t}" for c, t in zip(
    SCATTER_COLS, ["bigint", "string", "int", "int", "int", "int", "string", "string", "string", "string"]))


def _scatter_rows(spark, sf_dir):
    model = _fixed_centers()
    return adapter.with_derived(SCO.label(SCO.assign(adapter.customers(spark, sf_dir), model, scaled=False), model).drop("d2"))


@register("scatter_export")
def q_scatter_export(spark, sf_dir):
    """The 10-column plot records (fixed-center clusters) as JSON lines, read back."""
    path = fresh_path(spark, "scatter")
    W.write_records(W.to_public(_scatter_rows(spark, sf_dir)).select(*[F.col(f"`{c}`") for c in SCATTER_COLS]), path)
    return spark.read.schema(SCATTER_SCHEMA).json(path)


@register("scatter_colored")
def q_scatter_colored(spark, sf_dir):
    """The 8-column plot records with their segment's color, as JSON lines, read back."""
    path = fresh_path(spark, "scatter")
    rows = _scatter_rows(spark, sf_dir).join(lookups.segment_attributes(spark).select("segment", "color"), "segment", "left")
    W.write_records(rows.select(S.CUSTOMER_ID, S.GENDER, S.AGE, S.INCOME, S.SCORE, "cluster", "segment", "color"), path)
    return spark.read.schema(f"{S.CUSTOMER_ID} bigint, {S.GENDER} string, {S.AGE} int, {S.INCOME} int, {S.SCORE} int, "
                             "cluster int, segment string, color string").json(path)


# ---- A3 landing ingest -----------------------------------------------------
def write_landing(spark: SparkSession, sf_dir: str, path: str | None = None, day: str = "20240101", label: str = "nation",
                  only: F.Column | None = None) -> str:
    """One upload per nation, named ``YYYYMMDD_HHMMSS_nation_NN.csv`` (time = 2024-01-01 00:NN:00).

    ``path`` adds to a folder; ``only`` picks nations by ``c_nationkey``.  Every fifth upload has its columns in another order and one more column, and
    the one of nation 24 lacks the score.
    """
    raw = adapter.raw_customers(spark, sf_dir, extra=("c_nationkey",))
    k = F.col("c_nationkey")
    raw = raw if only is None else raw.filter(only)
    up = raw.withColumn("upload", F.format_string(f"{day}_00%02d00_{label}_%02d.csv", k, k)).repartition("upload")
    path = path or fresh_path(spark, "landing")
    names = [F.col(f"`{n}`") for n in S.REQUIRED_PUBLIC]
    kinds = [((k % 5 != 0) & (k != 24), names), (k % 5 == 0, [F.lit("x").alias("Note"), *reversed(names)]),
             (k == 24, names[:-1])]
    for rows, columns in kinds:
        (up.filter(rows).select("upload", *columns).write.mode("append").option("header", True)
         .partitionBy("upload").csv(path))
    return path


@register("landing_ingest")
def q_landing_ingest(spark, sf_dir):
    land = files.read_landing(spark, write_landing(spark, sf_dir))
    norm = V.normalize(land).withColumn("reject_reason", V.reject_reason(F.col("missing_columns")))
    return norm.groupBy("upload_label", "arrival_ts").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("reject_reason").isNull()).alias("valid_rows"))


# ---- training-backed queries: each trains on the tables it is given -------
def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.customers(spark, sf_dir).select(
        S.CUSTOMER_ID, S.GENDER, F.col(S.AGE).cast("smallint").alias(S.AGE),
        F.col(S.INCOME).cast("double").alias(S.INCOME), F.col(S.SCORE).cast("double").alias(S.SCORE))


def trained(spark: SparkSession, sf_dir: str, **config) -> TR.TrainResult:
    typed = _typed(spark, sf_dir)
    return TR.train_validated(spark, typed, typed.count(), "customer+orders", sf_dir, fresh_path(spark, "train"),
                              TR.TrainConfig(**config))


@register("kmeans_fit")
def q_kmeans_fit(spark, sf_dir):
    """K1: the fitted segmentation - per cluster name, size and center in original units."""
    return trained(spark, sf_dir, sweep=False).stats.select("cluster", "segment", "n", "pct", "cx", "cy")


@register("trained_segments")
def q_trained_segments(spark, sf_dir):
    """The segmented table written by the training run (cluster, segment, RFM proxies)."""
    return trained(spark, sf_dir, sweep=False).segmented


@register("context_summary_trained")
def q_context_summary_trained(spark, sf_dir):
    """D13 with the trained model's quality lines and its segments in cluster order."""
    from ..operators import reports as R
    r = trained(spark, sf_dir, sweep=False)
    shown = {k: (round(float(v), {"silhouette": 4, "davies": 3, "calinski": 1}.get(k, 6))
                 if isinstance(v, float) else v) for k, v in r.metrics.items()}
    return R.context_summary(r.segmented, label="customer+orders", metrics=shown, order="cluster")


def _sweep(spark, sf_dir):
    cust = adapter.customers(spark, sf_dir)
    scaler = SC.fit_standard(cust)
    frame, cols, _ = TR.joint_frame(cust, [scaler], scaler.n_rows)
    try:
        return MF.elbow_sweep(frame, cols, S.K_RANGE, S.KMEANS_SEARCH_N_INIT, scaler.n_rows, S.SAMPLE_SEED)
    finally:
        frame.unpersist()


@register("elbow_sweep")
def q_elbow_sweep(spark, sf_dir):
    """Inertia and squared-distance silhouette for every k, over all customers."""
    return spark.createDataFrame([(k, float(i), s) for k, i, s in _sweep(spark, sf_dir)],
                                 "k int, inertia double, silhouette double")


@register("best_k")
def q_best_k(spark, sf_dir):
    return spark.createDataFrame([(K.best_k(_sweep(spark, sf_dir)), S.FINAL_K)], "best_k int, final_k int")


@register("metrics_document")
def q_metrics_document(spark, sf_dir):
    """The metrics document of the fixed-center model over all customers, stored and read back."""
    cust = adapter.customers(spark, sf_dir)
    scaler = SC.fit_standard(cust)
    model = SCO.fixed_center_model(scaler)
    zcols = [f"z_{f}" for f in S.FEATURES]
    lab = SCO.assign(scaler.transform(cust), model).withColumn("prediction", F.col("cluster"))
    lab = K.vectors(lab.select(*zcols, "prediction", "d2"), zcols).persist()
    row = EV.dispersion(lab, zcols, "prediction").first()
    doc = {"silhouette": round(EV.silhouette_squared(lab), 4), "davies": round(row["davies_bouldin"], 3),
           "calinski": round(row["calinski_harabasz"], 1), "inertia": round(EV.inertia(lab).first()[0], 1),
           "aic": None, "bic": None, "n_iter": 0, "model_variant": model.variant, "preprocessor_variant": scaler.kind,
           "features": model.features, "best_k": None, "final_k": model.k, "candidate_results": []}
    lab.unpersist()
    path = fresh_path(spark, "document")
    W.write_document(spark, doc, W.METRICS_SCHEMA, path)
    return W.read_document(spark, path, W.METRICS_SCHEMA).drop("features", "candidate_results")


@register("candidate_results_document")
def q_candidate_results_document(spark, sf_dir):
    """A metrics document whose candidates are the ranked fixed labelings, stored and read back candidate by candidate."""
    ranked = q_label_ranking(spark, sf_dir).orderBy("position").collect()  # three rows
    best = ranked[0]
    doc = dict.fromkeys(W.METRICS_SCHEMA.fieldNames()) | {
        "davies": best["davies"], "calinski": best["calinski"], "n_iter": 0, "model_variant": best["labeling"],
        "preprocessor_variant": "standard", "features": list(S.FEATURES),
        "candidate_results": [{"variant": r["labeling"], "preprocessor": "standard", "features": list(S.FEATURES),
                               "davies": r["davies"], "calinski": r["calinski"]} for r in ranked]}
    path = fresh_path(spark, "document")
    W.write_document(spark, doc, W.METRICS_SCHEMA, path)
    found = W.read_document(spark, path, W.METRICS_SCHEMA)
    return found.select("model_variant", F.posexplode("candidate_results").alias("place", "c")).select(
        "model_variant", "place", "c.variant", "c.preprocessor", F.array_join("c.features", ",").alias("features"),
        "c.silhouette", "c.davies", "c.calinski", "c.inertia", "c.aic", "c.bic", "c.error")


@register("run_history")
def q_run_history(spark, sf_dir):
    """One run record per nation's customers, appended in two writes; the latest of each label and its runs."""
    cust = adapter.customers(spark, sf_dir, keep=("c_nationkey",))
    runs = cust.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("rows")).select(
        F.concat(F.lit("group_"), (F.col("c_nationkey") % 5).cast("string")).alias("dataset_label"),
        F.format_string("nation_%02d.csv", "c_nationkey").alias("dataset_path"),
        F.format_string("2024-01-01 00:%02d:00", "c_nationkey").alias("trained_at"), "rows",
        F.lit(None).cast("double").alias("silhouette"))
    path = fresh_path(spark, "run_history")
    for late in (True, False):
        W.append_runs(runs.filter((F.col("trained_at") >= "2024-01-01 00:12:00") == late), path)
    return W.latest_runs(spark, path)


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """Save the fixed-center model, load it, check compatibility, score with both."""
    cust = adapter.customers(spark, sf_dir)
    model = SCO.fixed_center_model(SC.fit_standard(cust))
    path = fresh_path(spark, "model")
    W.save_model(spark, model, path)
    loaded = W.load_model(spark, path)
    SCO.check_compatible(loaded, model.features)
    saved = SCO.assign(cust, model).select(S.CUSTOMER_ID, S.INCOME, S.SCORE, F.col("cluster").alias("saved_cluster"))
    return SCO.score(saved, loaded).groupBy("cluster", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster") != F.col("saved_cluster")).alias("changed"))


GRID_VARIANTS = ["kmeans", "minibatch_kmeans", "gaussian_mixture_full", "gaussian_mixture_diag"]
GRID_PREPROCESSORS = ["standard", "robust", "quantile_normal", "power_yeo_johnson"]


def grid(spark: SparkSession, sf_dir: str, variants=GRID_VARIANTS, preprocessors=GRID_PREPROCESSORS) -> list[TR.Candidate]:
    """K12 over model variants x preprocessors, each fitted and scored on all customers."""
    typed = _typed(spark, sf_dir).persist()
    try:
        return TR.evaluate_grid(typed, typed.count(), TR.TrainConfig(model_variants=variants, preprocessors=preprocessors))
    finally:
        typed.unpersist()


CAND_SCHEMA = ("variant string, preprocessor string, silhouette double, davies double, calinski double, "
               "inertia double, aic double, bic double, error string")


def _cand_rows(cands):
    return [(c.variant, c.preprocessor, c.silhouette, c.davies, c.calinski, c.inertia, c.aic, c.bic, c.error)
            for c in cands]


@register("candidate_grid")
def q_candidate_grid(spark, sf_dir):
    return spark.createDataFrame(_cand_rows(grid(spark, sf_dir)), CAND_SCHEMA)


@register("best_candidate")
def q_best_candidate(spark, sf_dir):
    """H3: lexicographic best of all 16 candidates (silhouette up, Davies-Bouldin down, Calinski up, 6 dp)."""
    ok = [c for c in grid(spark, sf_dir) if c.error is None]
    return spark.createDataFrame(_cand_rows([max(ok, key=TR.Candidate.key)]), CAND_SCHEMA)


@register("aic_bic")
def q_aic_bic(spark, sf_dir):
    """AIC / BIC of every candidate of the grid; null for the variants without a likelihood."""
    rows = _cand_rows(grid(spark, sf_dir))
    return spark.createDataFrame(rows, CAND_SCHEMA).select("variant", "preprocessor", "aic", "bic")
