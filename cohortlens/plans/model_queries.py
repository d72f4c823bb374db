"""Scaling, sampling, scoring, naming, metric and model-fitting queries."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..operators import cluster as K
from ..operators import multifit as MF
from ..operators import evaluate as EV
from ..operators import lookups
from ..operators import naming as NM
from ..operators import sampling as SM
from ..operators import scaling as SC
from ..operators import scoring as SCO
from ..operators import sketch
from ..operators.partials import spread
from ..session import fresh_path
from ..sources import adapter
from .catalog import register

Z = [f"z_{f}" for f in S.FEATURES]
SAMPLE_QUERY_N = 500  # size of the registered sampling query


# ---- S-1, J1, J2 -----------------------------------------------------------
@register("exact_sample")
def q_exact_sample(spark, sf_dir):
    cust = adapter.customers(spark, sf_dir)
    return SM.exact_sample(cust, SAMPLE_QUERY_N)


@register("standard_scale")
def q_standard_scale(spark, sf_dir):
    z = SC.standard_scale_lazy(adapter.customers(spark, sf_dir))
    return z.select(S.CUSTOMER_ID, *[F.round(c, 6).alias(c) for c in Z])


@register("robust_scale")
def q_robust_scale(spark, sf_dir):
    cust = adapter.customers(spark, sf_dir)
    rs = SC.fit_robust(cust)
    return rs.transform(cust, prefix="r_").select(
        S.CUSTOMER_ID, *[F.round(f"r_{f}", 6).alias(f"r_{f}") for f in S.FEATURES])


# ---- F6, F1, C12, K15, K16 ------------------------------------------------
def _fixed_model(cust: DataFrame) -> SCO.SegmentModel:
    return SCO.fixed_center_model(SC.fit_standard(cust))


def _fixed_centers() -> SCO.SegmentModel:
    """The fixed centers in original units: no statistics of the table are needed."""
    n = len(S.FEATURES)
    return SCO.fixed_center_model(SC.LinearScaler("none", list(S.FEATURES), [0.0] * n, [1.0] * n))


@register("nearest_centroid")
def q_nearest_centroid(spark, sf_dir):
    cust = adapter.customers(spark, sf_dir)
    return SCO.assign(cust, _fixed_centers(), scaled=False).select(S.CUSTOMER_ID, "cluster", "d2")


@register("label_join")
def q_label_join(spark, sf_dir):
    cust = adapter.customers(spark, sf_dir)
    model = _fixed_centers()
    return SCO.label(SCO.assign(cust, model, scaled=False).select(S.CUSTOMER_ID, "cluster"), model)


@register("score_requests_validated")
def q_score_requests_validated(spark, sf_dir):
    return SCO.validate_requests(adapter.score_requests(spark, sf_dir))


def _scored_requests(spark, sf_dir) -> DataFrame:
    model = _fixed_model(adapter.customers(spark, sf_dir))
    req = SCO.validate_requests(adapter.score_requests(spark, sf_dir)).filter(F.col("reject_reason").isNull())
    return SCO.score(req, model, cols=["income", "score"])


@register("score_requests")
def q_score_requests(spark, sf_dir):
    return _scored_requests(spark, sf_dir).select("request_id", "cluster", "segment", "dist", "confidence")


@register("prediction_confidence")
def q_prediction_confidence(spark, sf_dir):
    return _scored_requests(spark, sf_dir).select("request_id", "confidence")


@register("score_with_similar")
def q_score_with_similar(spark, sf_dir):
    cust = adapter.customers(spark, sf_dir)
    model = _fixed_model(cust)
    cust_scored = SCO.assign(cust, model)
    req = SCO.validate_requests(adapter.score_requests(spark, sf_dir)).filter(F.col("reject_reason").isNull())
    req = req.withColumnRenamed("income", S.INCOME).withColumnRenamed("score", S.SCORE)
    out = SCO.score_with_similar(req, cust_scored, model)
    return out.select("request_id", "cluster", "segment", "color", "strategy", "action", "rfm_behavior",
                      "confidence", "similar")


@register("score_with_similar_rows")
def q_score_with_similar_rows(spark, sf_dir):
    """K17 with one row per scored request and similar customer."""
    out = q_score_with_similar(spark, sf_dir)
    return out.select("request_id", "cluster", "segment", "confidence", F.posexplode("similar").alias("position", "s")).select(
        "request_id", "cluster", "segment", "confidence", "position", F.col(f"s.{S.CUSTOMER_ID}").alias("similar_id"),
        F.col(f"s.{S.INCOME}").alias("similar_income"), F.col(f"s.{S.SCORE}").alias("similar_score"))


# ---- K7-K10 on fixed labels -----------------------------------------------
@register("inertia")
def q_inertia(spark, sf_dir):
    cust = adapter.customers(spark, sf_dir)
    model = _fixed_model(cust)
    return EV.inertia(SCO.assign(cust, model)).select(F.round("inertia", 6).alias("inertia"))


def _scaled_segments(spark, sf_dir) -> DataFrame:
    """Rule-segmented customers, standardised by full-table moments."""
    cust = adapter.customers(spark, sf_dir)
    return SC.fit_standard(cust).transform(cust.withColumn("segment", C.rule_segment()))


@register("silhouette_euclidean")
def q_silhouette(spark, sf_dir):
    """K8: exact Euclidean silhouette of the rule segments over all customers."""
    s = EV.silhouette_exact(_scaled_segments(spark, sf_dir), Z, "segment")
    return s.select(F.round("silhouette", 6).alias("silhouette"))


@register("davies_bouldin")
def q_davies_bouldin(spark, sf_dir):
    return EV.davies_bouldin(_scaled_segments(spark, sf_dir), Z, "segment").select(
        F.round("davies_bouldin", 6).alias("davies_bouldin"))


@register("calinski_harabasz")
def q_calinski_harabasz(spark, sf_dir):
    return EV.calinski_harabasz(_scaled_segments(spark, sf_dir), Z, "segment").select(
        F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@register("silhouette_sq")
def q_silhouette_sq(spark, sf_dir):
    cust = adapter.customers(spark, sf_dir)
    scaler = SC.fit_standard(cust)
    vec = K.vectors(scaler.transform(cust.withColumn("segment", C.rule_segment())), Z)
    idx = F.when(F.col("segment") == S.SEGMENTS[0], 0)
    for i, s in enumerate(S.SEGMENTS[1:], start=1):
        idx = idx.when(F.col("segment") == s, i)
    vec = vec.withColumn("prediction", idx.cast("int"))
    value = EV.silhouette_squared(vec)
    return spark.createDataFrame([(round(value, 6),)], "silhouette_sq double")


# ---- K14 naming ------------------------------------------------------------
@register("greedy_naming")
def q_greedy_naming(spark, sf_dir):
    cust = adapter.customers(spark, sf_dir)
    cent = (SCO.assign(cust, _fixed_centers(), scaled=False).groupBy("cluster")
            .agg(F.avg(S.INCOME).alias("income"), F.avg(S.SCORE).alias("score")).orderBy("cluster").collect())  # k rows
    names = NM.greedy_names([(r["income"], r["score"]) for r in cent])
    return lookups.local_table(spark, [(r["cluster"], names[i], r["income"], r["score"]) for i, r in enumerate(cent) if i in names],
                               ["cluster", "segment", "income", "score"], ["int", "string", "double", "double"])


# ---- J3 / J4 nonlinear preprocessors, K2 / K3 / K4 model variants ------------
@register("quantile_normal")
def q_quantile_normal(spark, sf_dir):
    """Features through their empirical CDF to the standard normal."""
    cust = adapter.customers(spark, sf_dir)
    qn = SC.fit_quantile_normal(cust)
    return qn.transform(cust).select(S.CUSTOMER_ID, *[F.round(c, 6).alias(c) for c in Z])


QUANTILE_INCREMENTS = 4


@register("quantile_normal_incremental")
def q_quantile_normal_incremental(spark, sf_dir):
    """J3 from sketches kept as versions: each step reads its own customers and merges them into the state before."""
    cust = adapter.customers(spark, sf_dir)
    base = fresh_path(spark, "quantile-state")
    for i in range(QUANTILE_INCREMENTS):
        part = cust.filter(F.pmod(F.col(S.CUSTOMER_ID), F.lit(QUANTILE_INCREMENTS)) == i)
        state = sketch.take_increment(part, S.FEATURES, base, i)
    return SC.quantile_normal_of(state).transform(cust).select(S.CUSTOMER_ID, *[F.round(c, 6).alias(c) for c in Z])


INVERSE_POINTS = [-1.5, -0.5, 0.0, 0.75, 2.0]


@register("scaler_inverse")
def q_scaler_inverse(spark, sf_dir):
    """Fixed scaled points mapped back to original units by each fitted scaler with a closed inverse."""
    cust = adapter.customers(spark, sf_dir)
    fitted = {"standard": SC.fit_standard(cust), "robust": SC.fit_robust(cust), "yeo_johnson": SC.yeo_johnson_at(cust, YJ_LAMBDAS)}
    rows = [(name, z, *(round(v, 6) for v in scaler.inverse([z] * len(S.FEATURES)))) for name, scaler in fitted.items() for z in INVERSE_POINTS]
    return lookups.local_table(spark, rows, ["scaler", "z", *S.FEATURES], ["string", "double", "double", "double"])


@register("yeo_johnson")
def q_yeo_johnson(spark, sf_dir):
    """Yeo-Johnson with maximum-likelihood lambda, then standardised (rows check)."""
    cust = adapter.customers(spark, sf_dir).persist()
    yj = SC.fit_yeo_johnson(cust)
    cust.unpersist()
    out = yj.transform(adapter.customers(spark, sf_dir)).select(S.CUSTOMER_ID, *[F.round(c, 6).alias(c) for c in Z])
    lam = ", ".join(f"{f}={v:.4f}" for f, v in zip(yj.features, yj.lambdas))
    return out.withColumn("lambdas", F.lit(lam))


YJ_LAMBDAS = [0.8, 0.3]  # fixed lambdas of the checkable form


@register("yeo_johnson_given")
def q_yeo_johnson_given(spark, sf_dir):
    """J4 at given lambdas: transformed and standardised features."""
    cust = adapter.customers(spark, sf_dir)
    yj = SC.yeo_johnson_at(cust, YJ_LAMBDAS)
    return yj.transform(cust).select(S.CUSTOMER_ID, *[F.round(c, 6).alias(c) for c in Z])


@contextmanager
def _scaled_customers(spark, sf_dir):
    """(persisted scaled features with their vector, rows, mean variance); released at the end."""
    cust = adapter.customers(spark, sf_dir)
    scaler = SC.fit_standard(cust)
    vec = K.vectors(spread(scaler.transform(cust).select(*Z), scaler.n_rows), Z).persist()
    try:
        yield vec, scaler.n_rows, K.mean_variance(vec, Z)
    finally:
        vec.unpersist()


def _sizes(spark, labelled, name: str, **extra) -> DataFrame:
    """Rows per label (k rows) with the fit's figures, as a local table."""
    rows = labelled.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(name).collect()
    kinds = {int: "int", float: "double"}
    return lookups.local_table(spark, [(r[name], r["n"], *extra.values()) for r in rows], [name, "n", *extra],
                               ["int", "bigint", *[kinds[type(v)] for v in extra.values()]])


@register("minibatch_kmeans")
def q_minibatch_kmeans(spark, sf_dir):
    """K2: mini-batch k-means (batch 1024) on the standardised customers; cluster sizes."""
    from ..functions import distance as D
    with _scaled_customers(spark, sf_dir) as (vec, n, _):
        fits = [MF.Fit((0, 1), S.FINAL_K, seed) for seed in K.seeds_for(max(1, S.KMEANS_FINAL_N_INIT // 2))]
        MF.start_kmeans(spark, MF.start_sample(vec, Z, n, S.SAMPLE_SEED), fits, lloyd=False)
        found = MF.qualities(vec, Z, MF.fit_minibatch(vec, Z, fits, n))
        best = min(zip(found, fits), key=lambda x: x[0].inertia)[1]
        label = D.nearest_index(D.distance_array(Z, best.centers.tolist()))
        return _sizes(spark, vec.withColumn("cluster", label), "cluster", n_iter=best.n_iter)


def _mixture(spark, sf_dir, covariance: str) -> DataFrame:
    with _scaled_customers(spark, sf_dir) as (vec, n, _):
        fits = [MF.Fit((0, 1), S.FINAL_K, seed, covariance=covariance) for seed in K.seeds_for(max(2, S.KMEANS_FINAL_N_INIT // 2))]
        MF.start_kmeans(spark, MF.start_sample(vec, Z, n, S.SAMPLE_SEED), fits)
        best = MF.best_of(MF.fit_mixtures(vec, Z, fits, n, MF.column_variances(vec, Z)))[None]
        fit = K.MixtureFit(best.weights.tolist(), best.centers.tolist(), best.covariances.tolist(), best.mean_ll, best.n_iter, n)
        return _sizes(spark, vec.withColumn("component", K.mixture_label(Z, fit)), "component",
                      mean_log_likelihood=round(fit.mean_ll, 6), n_iter=fit.n_iter)


@register("gmm_full")
def q_gmm_full(spark, sf_dir):
    """K3: full-covariance Gaussian mixture by EM over all rows; component sizes."""
    return _mixture(spark, sf_dir, "full")


@register("gmm_diag")
def q_gmm_diag(spark, sf_dir):
    """K4: diagonal-covariance mixture by EM over all rows; component sizes."""
    return _mixture(spark, sf_dir, "diag")


def fixed_mixture() -> K.MixtureFit:
    """A mixture around the fixed centers, in original units: equal weights, one spread per feature."""
    k = len(S.FIXED_CENTERS)
    return K.MixtureFit([1.0 / k] * k, [[x, y] for _, x, y in S.FIXED_CENTERS], [[[400.0, 60.0], [60.0, 225.0]]] * k, 0.0, 0, 0)


@register("mixture_aic_bic")
def q_mixture_aic_bic(spark, sf_dir):
    """Log-likelihood, AIC and BIC of the fixed full-covariance mixture over all customers."""
    row = K.mixture_log_likelihood(adapter.customers(spark, sf_dir), S.FEATURES, fixed_mixture()).first()
    aic, bic = EV.aic_bic(row["log_likelihood"], row["n"], S.FINAL_K, len(S.FEATURES), "full")
    return lookups.local_table(spark, [(row["n"], round(row["log_likelihood"], 4), round(aic, 4), round(bic, 4))],
                               ["n", "log_likelihood", "aic", "bic"], ["bigint", "double", "double", "double"])


@register("lloyd_steps")
def q_lloyd_steps(spark, sf_dir):
    """K1's step: three Lloyd steps from the fixed centers over all customers."""
    out = K.lloyd_steps(adapter.customers(spark, sf_dir), S.FEATURES, [[x, y] for _, x, y in S.FIXED_CENTERS], 3)
    return out.select("cluster", "n", *[F.round(f, 6).alias(f) for f in S.FEATURES])


GIVEN_STEPS = 2
GIVEN_K = [2, 3, 4, 5]


@contextmanager
def _plain_features(spark, sf_dir):
    """The features as doubles in original units, persisted; released at the end."""
    frame = adapter.customers(spark, sf_dir).select(*[F.col(f).cast("double").alias(f) for f in S.FEATURES]).persist()
    try:
        yield frame
    finally:
        frame.unpersist()


@register("sweep_given")
def q_sweep_given(spark, sf_dir):
    """K1, K13, H4 from given starts: the first k fixed centers, two joint Lloyd steps; quality of every k and the best one."""
    with _plain_features(spark, sf_dir) as frame:
        fits = [MF.Fit((0, 1), k, 0, race=k, centers=np.array([[x, y] for _, x, y in S.FIXED_CENTERS[:k]], float)) for k in GIVEN_K]
        MF.fit_kmeans(frame, S.FEATURES, fits, MF.column_variances(frame, S.FEATURES), max_iter=GIVEN_STEPS, rel_tol=0.0)
        found = MF.qualities(frame, S.FEATURES, fits)
    best = K.best_k([(f.k, f.cost, None if q.silhouette is None else round(q.silhouette, 6)) for f, q in zip(fits, found)])
    rows = [(f.k, round(f.cost, 4), round(q.silhouette, 6), round(q.davies, 6), round(q.calinski, 4), f.k == best) for f, q in zip(fits, found)]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, davies double, calinski double, best boolean")


@register("mixture_steps_given")
def q_mixture_steps_given(spark, sf_dir):
    """K3, K4, K6 from given starts: two EM steps around the fixed centers, full and diagonal side by side; the components."""
    with _plain_features(spark, sf_dir) as frame:
        n = frame.count()
        fits = [MF.Fit((0, 1), len(S.FIXED_CENTERS), 0, race=c, covariance=c, centers=np.array([[x, y] for _, x, y in S.FIXED_CENTERS], float))
                for c in ("full", "diag")]
        MF.fit_mixtures(frame, S.FEATURES, fits, n, MF.column_variances(frame, S.FEATURES), max_iter=GIVEN_STEPS, tol=0.0, rungs=())
    rows = [(f.covariance, j, *(round(float(v), 4) for v in (f.weights[j], *f.centers[j], f.covariances[j][0, 0], f.covariances[j][0, 1],
                                                             f.covariances[j][1, 1], f.mean_ll))) for f in fits for j in range(f.k)]
    return spark.createDataFrame(rows, "covariance string, component int, weight double, income_k double, score double, "
                                       "var_income double, covar double, var_score double, mean_log_likelihood double")


@register("label_ranking")
def q_label_ranking(spark, sf_dir):
    """H3 over fixed labelings of the customers: metrics of each, best first."""
    cust = adapter.customers(spark, sf_dir)
    z = SC.fit_standard(cust).transform(cust.withColumn("rule", C.rule_segment()).withColumn("recency", C.r_band())
                                        .withColumn("monetary", C.m_band()))
    parts = [EV.dispersion(z, Z, name).select(F.lit(name).alias("labeling"), F.round("davies_bouldin", 6).alias("davies"),
                                              F.round("calinski_harabasz", 6).alias("calinski"))
             for name in ("rule", "recency", "monetary")]
    rank = F.row_number().over(Window.orderBy(F.col("davies").asc(), F.col("calinski").desc(), "labeling"))  # three rows
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("position", rank)


# ---- cluster-quality metrics on the labelled embedding vectors ----------------
def _embeddings(spark, sf_dir):
    """Labelled vectors: the array column itself, of whatever length."""
    from ..sources.tables import read_table
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")


@register("embedding_davies_bouldin")
def q_embedding_davies_bouldin(spark, sf_dir):
    return EV.davies_bouldin(_embeddings(spark, sf_dir), "embedding", "label").select(
        F.round("davies_bouldin", 6).alias("davies_bouldin"))


@register("embedding_calinski_harabasz")
def q_embedding_calinski_harabasz(spark, sf_dir):
    return EV.calinski_harabasz(_embeddings(spark, sf_dir), "embedding", "label").select(
        F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@register("embedding_silhouette")
def q_embedding_silhouette(spark, sf_dir):
    """Exact silhouette of the labels over all vectors."""
    return EV.silhouette_exact(_embeddings(spark, sf_dir), "embedding", "label").select(
        F.round("silhouette", 6).alias("silhouette"))
