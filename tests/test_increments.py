"""As-of join, versioned state, upload ledger and streaming k-means: brute force, and steps that run twice."""
import bisect
import datetime as dt
import random

from pyspark.sql import functions as F

from cohortlens.operators import rfm
from cohortlens.operators.asof import asof_join
from cohortlens.operators import scaling as SC
from cohortlens.operators import scoring as SCO
from cohortlens.session import fresh_path
from cohortlens.sinks import versions
from cohortlens.sources import adapter, files
from cohortlens.sources.tables import read_table
from cohortlens.streaming import jobs as P
from support import SF_SMALL


def test_asof_join_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(1)
    day = lambda n: None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    left = [(rng.choice([7] * 5 + [1, 2, 3, None]), day(rng.choice([rng.randint(0, 300), None] if i % 40 == 0 else [rng.randint(0, 300)])), i)
            for i in range(900)]
    left += [(7, day(100), 5000)] * 50 + [(9, day(3), 5001)]
    right = [(rng.choice([7, 7, 1, 2, 8, None]), day(rng.randint(0, 300)), f"v{i}", i) for i in range(300)] + [(7, None, "x", 1)]
    history = {}
    for k, t, a, b in right:
        if k is not None and t is not None:
            history.setdefault(k, {}).setdefault(t, []).append((a, b))

    def held(k, t):
        times = sorted(history.get(k, {}))
        at = bisect.bisect_right(times, t) if t is not None else 0
        return max(history[k][times[at - 1]]) if at else (None, None)
    want = sorted(((k, t, i, *held(k, t)) for k, t, i in left), key=str)
    one = spark.createDataFrame(left, "k int, t timestamp_ntz, value int").repartition(4)
    two = spark.createDataFrame(right, "c int, since timestamp_ntz, a string, b int").withColumnRenamed("c", "k")
    for partitions in (1, 23):
        got = asof_join(one, two, "k", "t", "since", ["a", "b"], partitions)
        assert got.columns == ["k", "t", "value", "a", "b"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert asof_join(one.limit(0), two, "k", "t", "since", ["a"]).count() == 0


def test_held_drift_does_not_depend_on_the_ranges(spark):
    orders = read_table(spark, SF_SMALL, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 > 0, 7).otherwise(F.col("o_custkey")))
    history = rfm.band_history(orders)
    one, many = (sorted(map(tuple, rfm.held_drift(orders, history, n).collect())) for n in (1, 40))
    assert one == many and sum(r[3] for r in one) == orders.count()


def test_rfm_increments_merge_and_replay(spark):
    orders, base = read_table(spark, SF_SMALL, "orders"), fresh_path(spark, "test-rfm")
    day, (one, two) = F.col("o_orderdate"), (F.lit(x).cast("timestamp_ntz") for x in ("1997-01-01", "2000-01-01"))
    parts = [orders.filter(day < one), orders.filter((day >= one) & (day < two)), orders.filter(day >= two)]
    rfm.take_increment(parts[0], base, 0)
    rfm.take_increment(parts[1], base, 1)
    rfm.take_increment(parts[1], base, 1)  # the step ran, and runs again after a crash
    state = rfm.take_increment(parts[2], base, 2)
    assert versions.numbers(spark, base) == [0, 1, 2]
    key = lambda r: r[0]
    assert sorted(map(tuple, rfm.rfm_of_state(state).collect()), key=key) == sorted(map(tuple, rfm.true_rfm(orders).collect()), key=key)
    merged = rfm.merge_partials(versions.before(spark, base, 2), rfm.rfm_partials(parts[2]))
    read = merged.inputFiles()
    assert any("version=1" in f for f in read) and not any("version=0" in f or "version=2" in f for f in read)
    scan = next(x for x in merged._jdf.queryExecution().executedPlan().toString().splitlines() if "o_totalprice" in x and "FileScan" in x)
    assert "GreaterThanOrEqual(o_orderdate,2000" in scan  # only the new days' rows leave the scan


def test_an_upload_counts_once_whatever_is_run_twice(spark, tmp_path):
    header = "CustomerID,Gender,Age,Annual Income (k$),Spending Score (1-100)"
    body = [f"{i},Male,{20 + i},50,40" for i in range(1, 6)]
    (tmp_path / "20240101_000000_a.csv").write_text("\n".join([header, *body]))
    (tmp_path / "20240101_000100_again.csv").write_text("\n".join([header, *reversed(body)]))  # the same lines
    (tmp_path / "20240101_000200_b.csv").write_text("\n".join([header, *body[:4], "5,Male,25,50,41"]))  # one differs
    model = SCO.fixed_center_model(SC.fit_standard(adapter.customers(spark, SF_SMALL)))
    out, ledger = fresh_path(spark, "test-out"), fresh_path(spark, "test-ledger")

    def taken(checkpoint):
        P.run_stream_score(spark, str(tmp_path), model, out, checkpoint, ledger=ledger).awaitTermination()
        rows = spark.read.parquet(f"{out}/scored").groupBy("upload_label").count().collect()
        return {r.upload_label: r["count"] for r in rows}
    first = fresh_path(spark, "test-ckpt")
    assert taken(first) == {"a": 5, "b": 5}
    # the sinks and the ledger were written, the checkpoint was lost: the batch comes again
    assert taken(fresh_path(spark, "test-ckpt")) == {"a": 5, "b": 5}
    (tmp_path / "20240102_000000_late.csv").write_text("\n".join([header, *body]))
    assert taken(first) == {"a": 5, "b": 5}  # a later batch knows the earlier entries
    assert sum(spark.read.parquet(versions.path_of(ledger, n)).count() for n in versions.numbers(spark, ledger)) == 2


def test_ledger_of_landing_rows_keeps_the_first_name(spark, tmp_path):
    for name in ("20240101_000000_z.csv", "20240101_000000_y.csv"):
        (tmp_path / name).write_text("CustomerID,Gender\n1,Male\n")
    batch = files.with_upload_info(files.landing_reader(spark.read).csv(str(tmp_path)))
    rows, entries = P.first_deliveries(batch, None)
    assert [r.upload_label for r in rows.select("upload_label").distinct().collect()] == ["y"] and entries.count() == 1
    assert P.first_deliveries(batch, entries)[0].count() == 0


def test_streaming_kmeans_follows_the_data_and_replays(spark):
    base = fresh_path(spark, "test-centers")
    batches = [[(0.0, 0.0), (2.0, 0.0), (10.0, 10.0)], [(4.0, 0.0)], [(6.0, 0.0), (12.0, 10.0)]]
    frames = [spark.createDataFrame(b, "x double, y double") for b in batches]
    for number in (0, 1, 1, 2, 2):
        P.update_centers(frames[number], ["x", "y"], base, number, [[0.0, 0.0], [10.0, 10.0], [-99.0, 0.0]], 0.5)
    got = {r.cluster: (r.weight, r.center) for r in versions.latest(spark, base).collect()}
    # cluster 0: (0+2)/2 = 1 with weight 2; (1*1 + 4)/2 = 2.5 with weight 2; (1*2.5 + 6)/2 = 4.25 with weight 2
    assert got[0] == (2.0, [4.25, 0.0])
    assert got[1][0] == 1.25 and got[1][1] == [(0.25 * 10 + 12) / 1.25, 10.0]
    assert got[2] == (0.0, [-99.0, 0.0])  # nothing near it: it stays
