"""Derive customer tables from the driver's TPC-H-like tables.

The driver's tables hold no mall data, so the customer table is derived from
``customer`` and ``orders``: income from the account balance, spending score
from each customer's share of the largest order spend.  Gender and age are
synthetic (from the key).  Work grows with both tables; the only exchanges are
the order aggregation (with map-side partial sums, so a customer holding a
third of all orders costs one partial row per task) and the key join, which
sees at most one row per customer on the aggregated side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from .tables import read_table


def order_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total order value per customer in integer cents.

    The key filter is explicit so the customer join and the max-spend scalar
    subquery see the SAME aggregate plan, and Spark reuses its exchange: the
    orders table is scanned and shuffled once.
    """
    orders = read_table(spark, sf_dir, "orders").filter(F.col("o_custkey").isNotNull())
    return orders.groupBy("o_custkey").agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")
    )


def customers(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed customer table: customer_id, gender, age, income_k, score (all integers but gender).

    ``keep`` carries extra ``customer`` columns through (no second scan or join).
    """
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", *keep)
    spend = order_spend(spark, sf_dir)
    max_cents = spend.select(F.max("cents")).scalar()  # scalar subquery, no cross join
    joined = cust.join(spend, cust.c_custkey == spend.o_custkey, "left")
    k = F.col("c_custkey")
    return joined.select(
        (k + 1).cast("bigint").alias(S.CUSTOMER_ID),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias(S.GENDER),
        (F.lit(18) + k % 53).cast("int").alias(S.AGE),
        (F.lit(15) + F.floor((F.col("c_acctbal") + 1000) * 122 / 11000)).cast("int").alias(S.INCOME),
        (F.lit(1) + F.floor(F.lit(99.0) * F.coalesce(F.col("cents"), F.lit(0)) / max_cents))
        .cast("int").alias(S.SCORE),
        *keep,
    )


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer table with the derived columns of the segmented table.

    The segment is the rule segment (income/score thresholds), which is
    deterministic and identical in every engine; model segments come from
    :mod:`cohortlens.operators.scoring`.
    """
    return with_derived(customers(spark, sf_dir))


def with_derived(df: DataFrame, segment_col=None) -> DataFrame:
    seg = segment_col if segment_col is not None else C.rule_segment()
    out = df.withColumn("gender_enc", C.gender_enc())
    if "segment" not in df.columns:
        out = out.withColumn("segment", seg)
    return (
        out.withColumn("r_proxy", C.r_band())
        .withColumn("f_proxy", C.f_band())
        .withColumn("m_proxy", C.m_band())
        .withColumn("rfm_segment", F.col("segment"))
    )


def raw_customers(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The customer table as a raw text file would deliver it (all STRING).

    Formatting varies the way uploaded files do (case, padding, ``66.0``-style
    integers), and a small, key-determined share of rows carries defects:
    unknown genders (the market segment), blanks, ``NA`` tokens, text in
    numeric fields and out-of-range values.  Every row of the source survives.
    """
    df = customers(spark, sf_dir, keep=("c_mktsegment", *extra))
    i = F.col(S.CUSTOMER_ID)
    g = F.col(S.GENDER)
    s = lambda c: F.col(c).cast("string")
    gender = (
        F.when(i % 97 == 5, F.col("c_mktsegment"))
        .when(i % 89 == 3, F.lit(None).cast("string"))
        .when(i % 83 == 2, F.lit("NA"))
        .when(i % 10 == 1, F.upper(g))
        .when(i % 10 == 2, F.concat(F.lit(" "), F.lower(g), F.lit(" ")))
        .when(i % 10 == 3, F.concat(F.lower(g), F.lit("\t")))
        .when(i % 10 == 4, F.concat(F.lit("\u00a0"), g, F.lit("\u00a0")))
        .otherwise(g)
    )
    cid = F.when(i % 211 == 17, F.concat(F.lit("C"), s(S.CUSTOMER_ID))).otherwise(s(S.CUSTOMER_ID))
    age = (
        F.when(i % 131 == 4, F.lit("101"))
        .when(i % 127 == 9, F.lit("NA"))
        .when(i % 109 == 11, F.concat(s(S.AGE), F.lit("d")))
        .when(i % 7 == 3, F.concat(s(S.AGE), F.lit(".0")))
        .otherwise(s(S.AGE))
    )
    income = (
        F.when(i % 139 == 6, F.concat(F.lit("-"), s(S.INCOME)))
        .when(i % 113 == 5, F.lit("abc"))
        .when(i % 107 == 12, F.lit("0x1p3"))
        .when(i % 5 == 4, F.concat(s(S.INCOME), F.lit(".0")))
        .otherwise(s(S.INCOME))
    )
    score = (
        F.when(i % 149 == 8, F.lit("0"))
        .when(i % 151 == 10, F.lit("NaN"))
        .otherwise(s(S.SCORE))
    )
    return df.select(
        cid.alias(S.PUBLIC_NAMES[S.CUSTOMER_ID]),
        gender.alias(S.PUBLIC_NAMES[S.GENDER]),
        age.alias(S.PUBLIC_NAMES[S.AGE]),
        income.alias(S.PUBLIC_NAMES[S.INCOME]),
        score.alias(S.PUBLIC_NAMES[S.SCORE]),
        *extra,
    )


def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests derived from ``orders`` (one per order).

    Ranges deliberately exceed the accepted ones (age 0..102, income 1..499,
    score 0..101) so the request validation has work to do.
    """
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("request_id"),
        (k % 103).cast("int").alias("age"),
        F.when(k % 3 == 0, "Female").otherwise("Male").alias("gender"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("income"),
        (F.col("o_custkey") % 102).cast("double").alias("score"),
    )
