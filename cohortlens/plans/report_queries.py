"""Report, filter, validation and projection queries over the derived customer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..operators import reports as R
from ..operators import validate as V
from ..operators import rfm
from ..session import fresh_path
from ..sinks import writers as W
from ..sources import adapter
from ..sources.tables import read_table
from .catalog import register


def _seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.segmented(spark, sf_dir)


# ---- derived columns ------------------------------------------------------
@register("rule_segment")
def q_rule_segment(spark, sf_dir):
    return adapter.customers(spark, sf_dir).select(
        S.CUSTOMER_ID, S.INCOME, S.SCORE, C.rule_segment().alias("segment"))


@register("gender_enc")
def q_gender_enc(spark, sf_dir):
    return adapter.customers(spark, sf_dir).select(S.CUSTOMER_ID, S.GENDER, C.gender_enc().alias("gender_enc"))


@register("rfm_bands")
def q_rfm_bands(spark, sf_dir):
    return _seg(spark, sf_dir).select(S.CUSTOMER_ID, "r_proxy", "f_proxy", "m_proxy", "rfm_segment")


# ---- aggregations ---------------------------------------------------------
@register("segment_stats")
def q_segment_stats(spark, sf_dir):
    return R.segment_stats(_seg(spark, sf_dir))


@register("overview")
def q_overview(spark, sf_dir):
    return R.overview(_seg(spark, sf_dir))


@register("cluster_balance")
def q_cluster_balance(spark, sf_dir):
    return R.cluster_balance(_seg(spark, sf_dir))


@register("rfm_high_pct")
def q_rfm_high_pct(spark, sf_dir):
    return R.rfm_high_pct(_seg(spark, sf_dir))


@register("revenue_share")
def q_revenue_share(spark, sf_dir):
    return R.revenue_share(_seg(spark, sf_dir))


@register("impact_summary")
def q_impact_summary(spark, sf_dir):
    return R.impact_summary(_seg(spark, sf_dir))


@register("gender_split")
def q_gender_split(spark, sf_dir):
    return R.gender_split(_seg(spark, sf_dir))


@register("at_risk_profile")
def q_at_risk_profile(spark, sf_dir):
    return R.at_risk_profile(_seg(spark, sf_dir))


@register("segment_distribution")
def q_segment_distribution(spark, sf_dir):
    return R.segment_distribution(_seg(spark, sf_dir))


@register("segment_list")
def q_segment_list(spark, sf_dir):
    return R.segment_list(_seg(spark, sf_dir))


@register("feature_moments")
def q_feature_moments(spark, sf_dir):
    return R.feature_moments(adapter.customers(spark, sf_dir))


@register("segment_profile")
def q_segment_profile(spark, sf_dir):
    return R.segment_profile(_seg(spark, sf_dir))


@register("campaign_fit")
def q_campaign_fit(spark, sf_dir):
    return R.campaign_fit(_seg(spark, sf_dir))


@register("campaign_audience")
def q_campaign_audience(spark, sf_dir):
    return R.campaign_audience(_seg(spark, sf_dir))


@register("rfm_criteria")
def q_rfm_criteria(spark, sf_dir):
    return R.rfm_criteria(_seg(spark, sf_dir))


@register("segment_attributes")
def q_segment_attributes(spark, sf_dir):
    return R.segment_attributes_join(_seg(spark, sf_dir))


@register("context_summary")
def q_context_summary(spark, sf_dir):
    return R.context_summary(_seg(spark, sf_dir), label="customer+orders")


# ---- filters / top-k ------------------------------------------------------
@register("customers_by_segment")
def q_customers_by_segment(spark, sf_dir):
    return R.customers_by_segment(_seg(spark, sf_dir), segment=S.VIP)


@register("customer_lookup")
def q_customer_lookup(spark, sf_dir):
    return R.customer_lookup(_seg(spark, sf_dir), search=" 42 ")


@register("customer_lookup_published")
def q_customer_lookup_published(spark, sf_dir):
    """E2 on a table published in ranges of the id: the lookup reads the row group that holds it."""
    path = fresh_path(spark, "lookup")
    W.publish_clustered(_seg(spark, sf_dir), path, [S.CUSTOMER_ID])
    return R.customer_lookup(spark.read.parquet(W.published(spark, path)), search=" 42 ")


@register("similar_customers_published")
def q_similar_customers_published(spark, sf_dir):
    """H2 for one segment of a table published in ranges of (segment, id): the first five read its first row groups."""
    path = fresh_path(spark, "similar")
    W.publish_clustered(_seg(spark, sf_dir), path, ["segment", S.CUSTOMER_ID])
    return (R.customers_by_segment(spark.read.parquet(W.published(spark, path)), S.LOYAL)
            .orderBy(S.CUSTOMER_ID).limit(S.SIMILAR_LIMIT))


@register("at_risk_list")
def q_at_risk_list(spark, sf_dir):
    return R.at_risk_list(_seg(spark, sf_dir))


@register("known_segments")
def q_known_segments(spark, sf_dir):
    return R.known_segments(_seg(spark, sf_dir)).select(S.CUSTOMER_ID, "segment")


@register("similar_customers")
def q_similar_customers(spark, sf_dir):
    return R.first_per_group(_seg(spark, sf_dir), "segment",
                             cols=[S.CUSTOMER_ID, S.GENDER, S.AGE, S.INCOME, S.SCORE, "segment"])


@register("chat_window")
def q_chat_window(spark, sf_dir):
    return R.chat_window(read_table(spark, sf_dir, "conversations"))


# ---- validation -----------------------------------------------------------
@register("validation_summary")
def q_validation_summary(spark, sf_dir):
    return V.summary(adapter.raw_customers(spark, sf_dir))


@register("gender_normalise")
def q_gender_normalise(spark, sf_dir):
    raw = adapter.raw_customers(spark, sf_dir)
    return raw.select(F.col("CustomerID").alias("customer_id_raw"),
                      C.normalize_gender("Gender").alias("gender"))


@register("invalid_genders")
def q_invalid_genders(spark, sf_dir):
    norm = V.normalize(adapter.raw_customers(spark, sf_dir))
    return V.invalid_gender_values(norm).withColumnRenamed(S.GENDER, "invalid_gender")


@register("numeric_coerce")
def q_numeric_coerce(spark, sf_dir):
    raw = adapter.raw_customers(spark, sf_dir)
    P = S.PUBLIC_NAMES
    return raw.select(
        F.col("CustomerID").alias("customer_id_raw"),
        *[C.to_number(F.col(f"`{P[c]}`")).alias(f"{c}_num") for c in S.NUMERIC_COLUMNS])


@register("quarantine")
def q_quarantine(spark, sf_dir):
    _good, bad = V.quarantine(adapter.raw_customers(spark, sf_dir))
    return bad


@register("validated_customers")
def q_validated_customers(spark, sf_dir):
    good, _bad = V.quarantine(adapter.raw_customers(spark, sf_dir))
    return good


@register("dataset_health")
def q_dataset_health(spark, sf_dir):
    return V.dataset_health(adapter.raw_customers(spark, sf_dir))


# ---- RFM from transactions, drift ----------------------------------------
@register("true_rfm")
def q_true_rfm(spark, sf_dir):
    return rfm.true_rfm(read_table(spark, sf_dir, "orders"))


@register("true_rfm_bands")
def q_true_rfm_bands(spark, sf_dir):
    return rfm.rfm_bands(rfm.true_rfm(read_table(spark, sf_dir, "orders")))


@register("rfm_cube")
def q_rfm_cube(spark, sf_dir):
    return rfm.rfm_cube(rfm.rfm_bands(rfm.true_rfm(read_table(spark, sf_dir, "orders"))))


@register("segment_drift")
def q_segment_drift(spark, sf_dir):
    return rfm.segment_drift(read_table(spark, sf_dir, "orders"), _seg(spark, sf_dir))


@register("segment_drift_wide")
def q_segment_drift_wide(spark, sf_dir):
    """L3 as a quarter x segment table (pivot over the known segment list)."""
    return rfm.segment_drift_wide(rfm.segment_drift(read_table(spark, sf_dir, "orders"), _seg(spark, sf_dir)))


@register("segment_drift_as_of")
def q_segment_drift_as_of(spark, sf_dir):
    """L3: drift between the bands that customers held at the dates of their orders (as-of join)."""
    orders = read_table(spark, sf_dir, "orders")
    return rfm.held_drift(orders, rfm.band_history(orders))


#: The increments of ``rfm_incremental``: orders before each date, then the rest.
RFM_CUTS = ("1996-07-01", "1999-01-01")


@register("rfm_incremental")
def q_rfm_incremental(spark, sf_dir):
    """M1 kept up to date: three increments of orders, each merged into the state published before it."""
    orders, base = read_table(spark, sf_dir, "orders"), fresh_path(spark, "rfm-state")
    day = F.col("o_orderdate")
    first, second = (F.lit(c).cast("timestamp_ntz") for c in RFM_CUTS)
    for number, rows in enumerate((day.isNull() | (day < first), (day >= first) & (day < second), day >= second)):
        state = rfm.take_increment(orders.filter(rows), base, number)
    return rfm.rfm_of_state(state)
