"""Lookups on a table published in ranges: row groups read, absent ids, the version that counts."""
from pyspark.sql import functions as F

from cohortlens.session import fresh_path
from cohortlens.sinks import writers as W


def _rows_scanned(df):
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return rows, sum(leaf.metrics().apply("numOutputRows").value() for leaf in _leaves(plan))


def _leaves(plan):
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def test_lookup_reads_one_row_group(spark):
    n = 60_000
    # even ids only, in an order that mixes them over all tasks
    df = spark.range(n).select((F.col("id") * 7919 % n * 2).alias("customer_id"), F.md5(F.col("id").cast("string")).alias("note"))
    path = fresh_path(spark, "test-lookup")
    W.publish_clustered(df.filter("customer_id < 10"), path, ["customer_id"])
    W.publish_clustered(df, path, ["customer_id"], partitions=6, row_group_bytes=64 * 1024)
    table = spark.read.parquet(W.published(spark, path))
    assert table.count() == n
    for wanted in (0, 4242, 2 * n - 2):
        rows, scanned = _rows_scanned(table.filter(F.col("customer_id") == wanted))
        assert [r.customer_id for r in rows] == [wanted] and 0 < scanned <= n / 12
    rows, scanned = _rows_scanned(table.filter(F.col("customer_id") == 4243))  # inside a range, but the bloom filter has no such id
    assert rows == [] and scanned <= n / 12
    assert sum(_rows_scanned(table.filter(F.col("customer_id") == 2 * i + 1))[1] for i in range(5000, 5020)) <= n / 12


def test_lookup_by_two_keys_and_an_empty_table(spark):
    df = spark.range(20_000).select((F.col("id") % 5).alias("segment"), (F.col("id") * 31 % 20_000).alias("customer_id"))
    path = fresh_path(spark, "test-lookup")
    W.publish_clustered(df, path, ["segment", "customer_id"], partitions=10)
    table = spark.read.parquet(W.published(spark, path))
    rows, scanned = _rows_scanned(table.filter("segment = 3 and customer_id < 300"))
    assert len(rows) == df.filter("segment = 3 and customer_id < 300").count() > 0 and scanned <= 6_000
    W.publish_clustered(df.limit(0), path, ["customer_id"])
    assert spark.read.parquet(W.published(spark, path)).count() == 0
