"""As-of join: each row with the last row of another table at or before its time, under one key.

Both tables' rows are put together and dealt to ranges of (key, time), so a key with
a third of all rows lies in many ranges and no task holds it.  Within a range a
window carries the last value forward; into a range comes the key's last value of
the ranges before, from a table of one row per (range, key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str],
              partitions: int | None = None) -> DataFrame:
    """The rows of ``left`` with ``values`` of the last row of ``right`` whose time is at most theirs, else null.

    A null key or time matches nothing; of several rows of ``right`` with one key and
    time the one with the greatest values counts.
    """
    spark = left.sparkSession
    partitions = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    value = F.struct(*[F.col(v) for v in values])
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    ours = left.select(F.col(key).alias("k"), F.col(left_time).alias("t"), F.lit(1).alias("side"), row.alias("row"),
                       F.xxhash64(*left.columns).alias("tie"))
    theirs = right.select(F.col(key).alias("k"), F.col(right_time).alias("t"), F.lit(0).alias("side"), value.alias("value")).filter(
        "k is not null and t is not null")
    theirs = theirs.groupBy("k", "t", "side").agg(F.max("value").alias("value")).withColumn("tie", F.lit(0).cast("long"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    dealt = both.repartitionByRange(partitions, "k", "t", "side", "tie").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "asof-ranges")
    # The key's last value of each range, carried into the ranges after it.
    lasts = dealt.groupBy("k", "part").agg(F.max_by("value", F.when(F.col("side") == 0, F.col("t"))).alias("last"))
    line = W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select(F.col("k").alias("ck"), F.col("part").alias("cp"), F.last("last", ignorenulls=True).over(line).alias("carried"))
    inside = W.partitionBy("part", "k").orderBy("t", "side", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = dealt.withColumn("value", F.last("value", ignorenulls=True).over(inside)).filter("side = 1")
    found = found.join(carried, (F.col("k") == F.col("ck")) & (F.col("part") == F.col("cp")), "left")
    held = F.when(F.col("t").isNotNull(), F.coalesce("value", "carried"))
    return found.select("row", held.alias("held")).select("row.*", *[F.col("held").getField(v).alias(v) for v in values])
