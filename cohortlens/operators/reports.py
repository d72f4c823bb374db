"""Segment, RFM, retention and business-impact reports.

All per-segment reports derive from ONE grouped aggregation with map-side
partial sums (at most k output rows, so hot segments cost nothing extra),
instead of one pass per segment.  Totals over the k aggregated rows use a
window without partition, which only ever sees those k rows.  Averages of
integer columns are rounded exactly (integer division), so every engine
returns the same DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import columns as C
from . import lookups

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _integral(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, _INTEGRAL)


def _avg_round(total: str, n: str, digits: int, exact: bool) -> Column:
    if exact:
        return F.when(F.col(n) > 0, C.ratio_round(total, n, digits))
    return F.round(F.col(total) / F.col(n), digits)


def _all_rows() -> Window:
    # the frames this window runs over have at most k rows (one per segment)
    return Window.partitionBy()


def segment_aggregates(df: DataFrame, keys=("segment",)) -> DataFrame:
    """Sufficient statistics per segment: one hash aggregate, k rows out."""
    i, s, a = F.col(S.INCOME), F.col(S.SCORE), F.col(S.AGE)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(i).alias("_sum_income"),
        F.sum(s).alias("_sum_score"),
        F.sum(a).alias("_sum_age"),
        F.count_if(F.col(S.GENDER) == "Female").alias("_female"),
        F.count_if(s >= S.R_HIGH).alias("_high_r"),
        F.count_if(a <= S.F_HIGH).alias("_high_f"),
        F.count_if(i >= S.M_HIGH).alias("_high_m"),
        F.sum(i * s).alias("_rev100"),
    )


def _exactness(df: DataFrame) -> dict[str, bool]:
    return {c: _integral(df, c) for c in (S.INCOME, S.SCORE, S.AGE)}


# ---------------------------------------------------------------------------
# G1 overview
# ---------------------------------------------------------------------------
def overview(df: DataFrame) -> DataFrame:
    ex = _exactness(df)
    agg = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(S.INCOME).alias("_si"), F.sum(S.SCORE).alias("_ss"), F.sum(S.AGE).alias("_sa"),
        F.count_if(F.col(S.GENDER) == "Female").alias("_f"),
    )
    return agg.select(
        "total",
        _avg_round("_si", "total", 1, ex[S.INCOME]).alias("avg_income"),
        _avg_round("_ss", "total", 1, ex[S.SCORE]).alias("avg_score"),
        _avg_round("_sa", "total", 1, ex[S.AGE]).alias("avg_age"),
        C.pct_round("_f", "total", 1).alias("female_pct"),
    )


# ---------------------------------------------------------------------------
# G2 per-segment statistics (+ attributes), G3 balance, G9 distribution
# ---------------------------------------------------------------------------
def segment_stats(df: DataFrame, centers: dict[str, tuple[float, float]] | None = None,
                  keys=("segment",)) -> DataFrame:
    """n, pct, avg income/score (3 dp), avg age (1 dp), female %, centroid (1 dp).

    ``centers`` maps segment -> model centroid in original units; without it
    the centroid is the segment mean.
    """
    ex = _exactness(df)
    agg = segment_aggregates(df, keys)
    total = F.sum("n").over(_all_rows())
    out = agg.select(
        *keys, "n",
        C.pct_round("n", total, 1).alias("pct"),
        _avg_round("_sum_income", "n", 3, ex[S.INCOME]).alias("avg_income"),
        _avg_round("_sum_score", "n", 3, ex[S.SCORE]).alias("avg_score"),
        _avg_round("_sum_age", "n", 1, ex[S.AGE]).alias("avg_age"),
        C.pct_round("_female", "n", 1).alias("female_pct"),
        *_centroid_cols(centers, ex),
    )
    attrs = lookups.segment_attributes(df.sparkSession)
    return out.join(attrs, "segment", "left")


def _centroid_cols(centers, ex) -> list[Column]:
    if centers is None:
        return [_avg_round("_sum_income", "n", 1, ex[S.INCOME]).alias("cx"),
                _avg_round("_sum_score", "n", 1, ex[S.SCORE]).alias("cy")]
    cx = F.lit(None).cast("double")
    cy = F.lit(None).cast("double")
    for seg, (x, y) in centers.items():
        cx = F.when(F.col("segment") == seg, F.lit(round(float(x), 1))).otherwise(cx)
        cy = F.when(F.col("segment") == seg, F.lit(round(float(y), 1))).otherwise(cy)
    return [cx.alias("cx"), cy.alias("cy")]


def cluster_balance(df: DataFrame) -> DataFrame:
    """Name, count, pct, color per segment."""
    agg = df.groupBy("segment").agg(F.count(F.lit(1)).alias("count"))
    out = agg.select("segment", "count",
                     C.pct_round("count", F.sum("count").over(_all_rows()), 1).alias("pct"))
    return out.join(lookups.segment_attributes(df.sparkSession).select("segment", "color"), "segment", "left")


def segment_distribution(df: DataFrame) -> DataFrame:
    """Count and whole-percent share (JavaScript ``Math.round``)."""
    agg = df.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(_all_rows())
    return agg.select("segment", "n", C.int_round(F.col("n") * 100, total).alias("share_pct"))


# ---------------------------------------------------------------------------
# G4 / F3 RFM high shares, G5 revenue share, G6 impact, G7 gender, G8 at-risk
# ---------------------------------------------------------------------------
def rfm_high_pct(df: DataFrame) -> DataFrame:
    agg = segment_aggregates(df)
    total = F.sum("n").over(_all_rows())
    return agg.select(
        "segment", "n",
        C.pct_round("n", total, 1).alias("pct"),
        C.pct_round("_high_r", "n", 1).alias("high_r_pct"),
        C.pct_round("_high_f", "n", 1).alias("high_f_pct"),
        C.pct_round("_high_m", "n", 1).alias("high_m_pct"),
    )


def revenue_share(df: DataFrame) -> DataFrame:
    """Share of the revenue proxy ``income * score / 100`` per segment (1 dp, 0 if no revenue)."""
    exact = _integral(df, S.INCOME) and _integral(df, S.SCORE)
    agg = df.groupBy("segment").agg(F.sum(F.col(S.INCOME) * F.col(S.SCORE)).alias("_rev100"))
    total = F.sum("_rev100").over(_all_rows())
    if exact:
        share = C.pct_round("_rev100", total, 1)
    else:
        share = F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col("_rev100") / total * 100, 1))
    return agg.select("segment", (F.col("_rev100") / F.lit(100)).alias("revenue"), share.alias("rev_share_pct"))


def impact_summary(df: DataFrame) -> DataFrame:
    agg = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("segment") == S.AT_RISK).alias("at_risk_count"),
        F.count_if(F.col("segment") == S.VIP).alias("vip_count"),
    )
    wrong = F.greatest(F.col("total") - F.col("vip_count"), F.lit(0))
    return agg.select(
        "total", "at_risk_count", "vip_count",
        C.pct_round("vip_count", "total", 1).alias("vip_pct"),
        C.pct_round("at_risk_count", "total", 1).alias("at_risk_pct"),
        wrong.alias("wrong_offer_count"),
        C.pct_round(wrong, "total", 1).alias("efficiency_waste_pct"),
    )


def gender_split(df: DataFrame) -> DataFrame:
    """Female and male counts and shares per segment."""
    agg = df.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(S.GENDER) == "Female").alias("female"),
    )
    tenths = C.idiv(F.lit(2000) * F.col("female") + F.col("n"), F.lit(2) * F.col("n"))  # female % x 10
    return agg.select(
        "segment", "female", (F.col("n") - F.col("female")).alias("male"),
        (tenths / F.lit(10.0)).alias("female_pct"),
        C.idiv(F.lit(2) * (F.lit(1000) - tenths) + F.lit(10), F.lit(20)).alias("male_pct"),
    )


def at_risk_profile(df: DataFrame) -> DataFrame:
    """Count and whole-number means of the at-risk segment."""
    agg = df.filter(F.col("segment") == S.AT_RISK).agg(
        F.count(F.lit(1)).alias("at_risk_count"),
        F.sum(S.INCOME).alias("_si"), F.sum(S.SCORE).alias("_ss"), F.sum(S.AGE).alias("_sa"),
    )
    ex = _exactness(df)

    def mean(c, exact):
        if exact:
            return F.when(F.col("at_risk_count") > 0, C.int_round(c, "at_risk_count"))
        return F.round(F.col(c) / F.col("at_risk_count")).cast("bigint")

    return agg.select(
        "at_risk_count",
        mean("_si", ex[S.INCOME]).alias("avg_income"),
        mean("_ss", ex[S.SCORE]).alias("avg_score"),
        mean("_sa", ex[S.AGE]).alias("avg_age"),
    )


# ---------------------------------------------------------------------------
# G11 / H1 segment list, G12 moments
# ---------------------------------------------------------------------------
def segment_list(df: DataFrame) -> DataFrame:
    """``All`` first, then the distinct segments in sorted order, with their position."""
    segs = df.select("segment").distinct()
    ranked = segs.select("segment", F.row_number().over(Window.orderBy("segment")).alias("position"))
    first = lookups.local_table(df.sparkSession, [("All", 0)], ["segment", "position"], ["string", "int"])
    return first.unionByName(ranked.select("segment", F.col("position").cast("int")))


def feature_moments(df: DataFrame, features=(S.INCOME, S.SCORE)) -> DataFrame:
    """Mean and population standard deviation of the model features (6 dp)."""
    cols = []
    for f in features:
        cols += [F.round(F.avg(f), 6).alias(f"mean_{f}"), F.round(F.stddev_pop(f), 6).alias(f"std_{f}")]
    return df.agg(*cols)


# ---------------------------------------------------------------------------
# E filters, H2 first-5 per group
# ---------------------------------------------------------------------------
CUSTOMER_VIEW = [S.CUSTOMER_ID, S.GENDER, S.AGE, S.INCOME, S.SCORE, "segment"]


def customers_by_segment(df: DataFrame, segment: str = "All") -> DataFrame:
    out = df if segment == "All" else df.filter(F.col("segment") == segment)
    return out.select(*CUSTOMER_VIEW)


def parse_search_id(search: str | None) -> int | None:
    """A search text that is not an integer means: no filter."""
    text = (search or "").strip()
    if not text:
        return None
    try:
        return int(text)
    except ValueError:
        return None


def customer_lookup(df: DataFrame, search: str | None, segment: str = "All") -> DataFrame:
    out = customers_by_segment(df, segment)
    cid = parse_search_id(search)
    return out if cid is None else out.filter(F.col(S.CUSTOMER_ID) == cid)


def at_risk_list(df: DataFrame, limit: int = S.AT_RISK_LIST_LIMIT) -> DataFrame:
    """The first ``limit`` at-risk customers by id (a top-k, not a full sort)."""
    return (df.filter(F.col("segment") == S.AT_RISK)
            .select(S.CUSTOMER_ID, S.GENDER, S.AGE, S.INCOME, S.SCORE, "r_proxy", "f_proxy")
            .orderBy(S.CUSTOMER_ID).limit(limit))


def known_segments(df: DataFrame) -> DataFrame:
    """E5: rows whose segment is in the segment lookup (left-semi, broadcast side of 5 rows)."""
    return df.join(lookups.segment_attributes(df.sparkSession).select("segment"), "segment", "left_semi")


def first_per_group(df: DataFrame, group: str, order: str = S.CUSTOMER_ID, n: int = S.SIMILAR_LIMIT,
                    cols=None) -> DataFrame:
    """H2: first ``n`` rows of every group by ``order``.

    ``row_number() <= n`` lets Spark insert a WindowGroupLimit below the
    exchange, so each map task ships at most n rows per group even when a
    group holds a third of the table.
    """
    w = Window.partitionBy(group).orderBy(order)
    out = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return out.select(*(cols or df.columns), "rank")


# ---------------------------------------------------------------------------
# D8, D10, D11, D13, F2, F5 page-level tables
# ---------------------------------------------------------------------------
def segment_attributes_join(df: DataFrame) -> DataFrame:
    """every customer with its segment's color, strategy, action and behaviour."""
    attrs = lookups.segment_attributes(df.sparkSession)
    return df.select(S.CUSTOMER_ID, "segment").join(attrs, "segment", "left")


def rfm_criteria(df: DataFrame) -> DataFrame:
    segs = df.select("segment").distinct()
    attrs = lookups.segment_attributes(df.sparkSession)
    j = segs.join(attrs, "segment", "inner")
    return j.select(
        "segment", "rfm_behavior",
        C.behaviour_level("rfm_behavior", "R").alias("recency"),
        C.behaviour_level("rfm_behavior", "F").alias("frequency"),
        C.behaviour_level("rfm_behavior", "M").alias("monetary"),
        F.col("strategy").alias("rfm_strategy"),
    )


def segment_profile(df: DataFrame) -> DataFrame:
    """Average income and the income bar relative to 137k (1 dp)."""
    ex = _exactness(df)
    agg = segment_aggregates(df)
    if ex[S.INCOME]:
        milli = C.idiv(F.lit(2000) * F.col("_sum_income") + F.col("n"), F.lit(2) * F.col("n"))  # avg x 1000
        bar = C.ratio_round(milli, F.lit(S.INCOME_SCALE_MAX * 10), 1)
        avg = milli / F.lit(1000.0)
    else:
        avg = F.round(F.col("_sum_income") / F.col("n"), 3)
        bar = F.round(avg / S.INCOME_SCALE_MAX * 100, 1)
    return agg.select("segment", "n", avg.alias("avg_income"), bar.alias("income_bar_pct"))


def campaign_fit(df: DataFrame) -> DataFrame:
    """Blanket premium campaign - only the VIP segment is a fit."""
    agg = df.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return agg.select(
        "segment", "n",
        C.pct_round("n", F.sum("n").over(_all_rows()), 1).alias("share_pct"),
        F.when(F.col("segment") == S.VIP, "OK").otherwise("MISS").alias("fit"),
    )


def campaign_audience(df: DataFrame, level: str = "High") -> DataFrame:
    """audience size per offer over the segments matched at ``level``."""
    counts = df.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    offers = lookups.offer_matrix(df.sparkSession).filter(F.col("level") == level)
    j = counts.join(offers, "segment", "inner")
    return j.groupBy("offer").agg(
        F.sum("n").alias("audience"),
        F.array_join(F.array_sort(F.collect_list("segment")), ", ").alias("segments"),
    )


def context_summary(df: DataFrame, label: str, metrics: dict | None = None, order: str = "segment") -> DataFrame:
    """Dashboard context text (header lines, model lines when ``metrics`` is given,
    then one line per segment in ``order``)."""
    ex = _exactness(df)
    agg = segment_aggregates(df, ("segment",) if order == "segment" else ("segment", order))
    line = F.concat(
        F.col("segment"), F.lit(": "), F.col("n").cast("string"), F.lit(" customers, avg income "),
        _avg_round("_sum_income", "n", 3, ex[S.INCOME]).cast("string"), F.lit("k, avg score "),
        _avg_round("_sum_score", "n", 3, ex[S.SCORE]).cast("string"),
    )
    lines = agg.select(F.col(order).alias("_o"), F.col("n"), line.alias("line"))
    body = lines.agg(
        F.sum("n").alias("rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "line"))),
                                 lambda x: x["line"]), "\n- ").alias("_segs"),
    )
    model_lines = ""
    if metrics is not None:
        model_lines = "".join(f"\n{k}: {metrics.get(v)}" for k, v in [
            ("Silhouette", "silhouette"), ("Davies-Bouldin", "davies"), ("Calinski-Harabasz", "calinski"),
            ("Model variant", "model_variant"), ("Preprocessing", "preprocessor_variant")])
    text = F.concat(F.lit(f"Dataset: {label}\nRows: "), F.col("rows").cast("string"),
                    F.lit(model_lines + "\nSegments:\n- "), F.col("_segs"))
    return body.select("rows", text.alias("context"))


# ---------------------------------------------------------------------------
# D14 / H6 chat window
# ---------------------------------------------------------------------------
def chat_window(conv: DataFrame, limit: int = S.CHAT_HISTORY_LIMIT) -> DataFrame:
    """Last ``limit`` turns of every conversation, roles normalised to user/assistant."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    ranked = conv.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    return ranked.select(
        "conv_id", "turn",
        F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"),
        "text",
    )
