"""RFM from transactions (recency, frequency, monetary), the RFM cube and segment drift.

The customer pages define R, F and M from purchase history and fall back to
proxies for lack of transactions; with ``orders`` at hand they are computed
directly.  Thresholds are fixed parameters (no global ``ntile``, which would
need a total sort in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..sinks import versions
from .asof import asof_join

# Band thresholds: recency in days (smaller is better), frequency in orders,
# monetary in currency units.
RECENCY_HIGH_DAYS, RECENCY_MODERATE_DAYS = 180, 365
FREQUENCY_HIGH, FREQUENCY_MODERATE = 12, 8
MONETARY_HIGH, MONETARY_MODERATE = 3_000_000, 1_500_000
QUARTER_HIGH, QUARTER_MODERATE = 400_000, 150_000  # revenue of one quarter


def rfm_partials(orders: DataFrame) -> DataFrame:
    """Per customer: last order, order count, revenue in cents; partials of disjoint orders merge."""
    return orders.groupBy("o_custkey").agg(
        F.max(F.to_date("o_orderdate")).alias("last_order"), F.count(F.lit(1)).alias("frequency"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


def merge_partials(state: DataFrame, more: DataFrame) -> DataFrame:
    return state.unionByName(more).groupBy("o_custkey").agg(
        F.max("last_order").alias("last_order"), F.sum("frequency").alias("frequency"), F.sum("cents").alias("cents"))


def take_increment(orders: DataFrame, base: str, number: int) -> DataFrame:
    """Version ``number`` of the RFM state below ``base``: the version before, merged with these orders only.

    Taken again, an increment starts from the version below its number and replaces its own.
    """
    state = versions.before(orders.sparkSession, base, number)
    new = rfm_partials(orders)
    return versions.write(new if state is None else merge_partials(state, new), base, number)


def rfm_of_state(state: DataFrame) -> DataFrame:
    """:func:`true_rfm` from a state; the last date is that of the state, orders are not read."""
    last_date = state.select(F.max("last_order")).scalar()
    return state.select((F.col("o_custkey") + 1).cast("bigint").alias(S.CUSTOMER_ID), "last_order",
                        F.datediff(last_date, F.col("last_order")).alias("recency_days"), "frequency",
                        (F.col("cents") / F.lit(100.0)).alias("monetary"))


def true_rfm(orders: DataFrame) -> DataFrame:
    """Per customer: days since the last order (to the data's last date), order count, revenue.

    One hash aggregate with map-side partials: a customer owning a third of
    all orders still ships one partial row per task.  Revenue is summed in
    integer cents, so it is exact and order independent.
    """
    per = orders.groupBy("o_custkey").agg(
        F.max(F.to_date("o_orderdate")).alias("last_order"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("_cents"),
    )
    # the data's last date: a one-column global max (partial max per task, no
    # shuffle of rows), evaluated once as a scalar subquery
    last_date = orders.select(F.max(F.to_date("o_orderdate"))).scalar()
    return per.select(
        (F.col("o_custkey") + 1).cast("bigint").alias(S.CUSTOMER_ID),
        "last_order",
        F.datediff(last_date, F.col("last_order")).alias("recency_days"),
        "frequency",
        (F.col("_cents") / F.lit(100.0)).alias("monetary"),
    )


def rfm_bands(rfm: DataFrame) -> DataFrame:
    r = (F.when(F.col("recency_days") <= RECENCY_HIGH_DAYS, "High")
         .when(F.col("recency_days") <= RECENCY_MODERATE_DAYS, "Moderate").otherwise("Low"))
    f = (F.when(F.col("frequency") >= FREQUENCY_HIGH, "High")
         .when(F.col("frequency") >= FREQUENCY_MODERATE, "Moderate").otherwise("Low"))
    m = (F.when(F.col("monetary") >= MONETARY_HIGH, "High")
         .when(F.col("monetary") >= MONETARY_MODERATE, "Moderate").otherwise("Low"))
    return rfm.select(S.CUSTOMER_ID, "recency_days", "frequency", "monetary",
                      r.alias("r_band"), f.alias("f_band"), m.alias("m_band"))


def rfm_cube(bands: DataFrame) -> DataFrame:
    """Counts for every R x F x M combination with all subtotals (``cube``)."""
    return bands.cube("r_band", "f_band", "m_band").agg(
        F.grouping_id().cast("int").alias("grouping_level"),
        F.count(F.lit(1)).alias("customers"),
    )


def segment_drift(orders: DataFrame, segmented: DataFrame) -> DataFrame:
    """Ordering customers per segment and quarter, and the change to the previous quarter.

    Orders are pre-aggregated per (customer, quarter) before the join, so a
    customer with a third of all orders reaches the join as one row per
    quarter; the join then carries the segment, and the window runs over
    the tiny (quarter x segment) table.
    """
    per_cust = orders.groupBy(
        (F.col("o_custkey") + 1).cast("bigint").alias(S.CUSTOMER_ID), F.trunc(F.to_date("o_orderdate"), "quarter").alias("quarter")
    ).agg(F.count(F.lit(1)).alias("_orders"))
    j = per_cust.join(segmented.select(S.CUSTOMER_ID, "segment"), S.CUSTOMER_ID)
    counts = j.groupBy("quarter", "segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("_orders").alias("orders"))
    w = Window.partitionBy("segment").orderBy("quarter")
    prev = F.lag("customers").over(w)
    return counts.select("quarter", "segment", "customers", "orders",
                         prev.alias("prev_customers"),
                         (F.col("customers") - prev).alias("change"))


def segment_drift_wide(drift: DataFrame) -> DataFrame:
    """Quarters as rows, segments as columns (pivot over the known segment list)."""
    return drift.groupBy("quarter").pivot("segment", S.SEGMENTS).agg(F.first("customers"))


def band_history(orders: DataFrame) -> DataFrame:
    """(o_custkey, valid_from, held): from the start of the next quarter on, a customer holds the band of a quarter's revenue."""
    quarter = F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp_ntz"))
    spent = orders.groupBy("o_custkey", quarter.alias("quarter")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    held = (F.when(F.col("cents") >= QUARTER_HIGH * 100, "High").when(F.col("cents") >= QUARTER_MODERATE * 100, "Moderate").otherwise("Low"))
    return spent.select("o_custkey", (F.col("quarter") + F.expr("INTERVAL 3 MONTHS")).cast("timestamp_ntz").alias("valid_from"),
                        held.alias("held"))


def held_drift(orders: DataFrame, history: DataFrame, partitions: int | None = None) -> DataFrame:
    """L3 by the band that a customer held at each order's date (``New`` before the first), by quarter, with the change."""
    orders = orders.select("o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    rows = asof_join(orders, history, "o_custkey", "o_orderdate", "valid_from", ["held"], partitions)
    per_cust = rows.groupBy(F.trunc(F.to_date("o_orderdate"), "quarter").alias("quarter"),
                            F.coalesce("held", F.lit("New")).alias("held"), "o_custkey").agg(F.count(F.lit(1)).alias("_orders"))
    counts = per_cust.groupBy("quarter", "held").agg(F.count(F.lit(1)).alias("customers"), F.sum("_orders").alias("orders"))
    prev = F.lag("customers").over(Window.partitionBy("held").orderBy("quarter"))
    return counts.select("quarter", "held", "customers", "orders", prev.alias("prev_customers"), (F.col("customers") - prev).alias("change"))
