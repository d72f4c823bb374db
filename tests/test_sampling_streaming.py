"""Sampling against brute force; streams against their batch equivalents."""
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cohortlens.operators import sampling as SM
from cohortlens.sources import adapter
from support import SF_CHECK, SF_SMALL


def test_cut_sample_equals_brute_force(spark):
    cust = adapter.customers(spark, SF_CHECK)
    for n in (5, 50, 700):
        fast = [r["customer_id"] for r in SM.exact_sample(cust, n).collect()]
        brute = [r["customer_id"] for r in SM.ranked_sample(cust, n).collect()]
        assert sorted(fast) == sorted(brute) and len(fast) == n


def test_small_table_is_returned_whole(spark):
    cust = adapter.customers(spark, SF_SMALL)
    assert SM.exact_sample(cust, 10_000).count() == cust.count()


def test_stream_score_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    stream = q["stream_score"](spark, SF_SMALL)
    batch = q["validated_customers"](spark, SF_SMALL)
    lost = adapter.customers(spark, SF_SMALL, keep=("c_nationkey",)).filter("c_nationkey = 24").select("customer_id")
    assert stream.count() == batch.join(lost, "customer_id", "left_anti").count()  # that upload lacks a column
    assert stream.filter(F.col("segment").isNull()).count() == 0
    assert stream.select("upload_label").distinct().count() == 24


def test_append_mode_gives_the_windows_of_complete_mode(spark):
    import __spark_entry__ as E
    q = E.queries()
    complete, append = ([tuple(r) for r in q[n](spark, SF_SMALL).collect()] for n in ("stream_segment_counts", "stream_segment_counts_append"))
    assert sorted(complete) == sorted(append) and len(append) > 0


def test_append_mode_keeps_events_of_files_in_any_order(spark, tmp_path):
    """Eight part files, the latest events in the largest one, which is written (and so was read) first."""
    import __spark_entry__ as E
    for name in os.listdir(SF_SMALL):
        if name != "events.parquet":
            os.symlink(f"{SF_SMALL}/{name}", tmp_path / name)
    events = pq.read_table(f"{SF_SMALL}/events.parquet").sort_by("ts")
    (tmp_path / "events.parquet").mkdir()
    at = [events.num_rows * i * (i + 1) // 72 for i in range(9)]
    for i in range(8):
        pq.write_table(events.slice(at[i], at[i + 1] - at[i]), tmp_path / f"events.parquet/part-{i}.parquet")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # one partition a file
    try:
        assert spark.read.parquet(str(tmp_path / "events.parquet")).rdd.getNumPartitions() == 8
        append = E.queries()["stream_segment_counts_append"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    complete = E.queries()["stream_segment_counts"](spark, SF_SMALL).collect()
    assert sorted(map(tuple, append)) == sorted(map(tuple, complete))
