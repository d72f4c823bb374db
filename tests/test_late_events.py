"""Windowed counts with late events kept apart: arrivals by hand, a batch that runs twice, no arrival at all."""
import datetime as dt
import os

from cohortlens.streaming import jobs as P
from cohortlens.streaming import late as LATE

DAY = dt.datetime(2024, 1, 1)


def arrive(spark, folder, day, events):
    rows = [(i, DAY + dt.timedelta(minutes=m), u, "x", 1.0, None) for i, m, u in events]
    spark.createDataFrame(rows, P.EVENTS_SCHEMA).write.parquet(f"{folder}/day={day}")


def run(spark, base, segments):
    LATE.run_late_counts(P.events_stream(spark, f"{base}/in", max_files=None), segments, f"{base}/out", f"{base}/ckpt",
                         delay="30 minutes").awaitTermination()
    out = LATE.read_out(spark, f"{base}/out")
    rows = [tuple(r) for r in out.select("segment", "start_ms", "event_id", "late", "n").collect()]
    totals = {(r.segment, r.window_start.hour): (r.events, r.late_events) for r in LATE.window_totals(out).collect()}
    return sorted(rows, key=str), totals


def test_late_events_are_kept_and_counts_close_once(spark, tmp_path):
    base = str(tmp_path)
    segments = spark.createDataFrame([(1, "A"), (2, "B")], "customer_id long, segment string")
    # user 0 is customer 1 and has most events (its salts share them); user 9 has no segment
    arrive(spark, f"{base}/in", 0, [(i, i % 60, 0) for i in range(100)] + [(100, 30, 1), (101, 95, 9)])
    _, totals = run(spark, base, segments)
    assert totals == {("A", 0): (100, 0), ("B", 0): (1, 0)}  # 95 - 30 minutes pass the first hour
    # out of order: an hour-0 event is late, hour 1 is open; 29 minutes more do not close it
    arrive(spark, f"{base}/in", 1, [(200, 10, 0), (201, 70, 0), (202, 20, 9), (203, 149, 1)])
    _, totals = run(spark, base, segments)
    assert totals == {("A", 0): (100, 1), ("B", 0): (1, 0), ("Unknown", 0): (0, 1)}
    arrive(spark, f"{base}/in", 2, [(300, 118, 0), (301, 119, 9), (302, 400, 1)])
    rows, totals = run(spark, base, segments)
    assert totals == {("A", 0): (100, 1), ("B", 0): (1, 0), ("Unknown", 0): (0, 1), ("A", 1): (2, 0), ("Unknown", 1): (2, 0), ("B", 2): (1, 0)}
    assert sorted(r[2] for r in rows if r[3]) == [200, 202]  # late events as they are; 302's window stays open
    assert all(r[2] is None for r in rows if not r[3])
    # a crash before the last commits: the batches run again and replace what they wrote
    commits = f"{base}/ckpt/commits"
    for name in sorted((n for n in os.listdir(commits) if n.isdigit()), key=int)[-1:]:
        os.remove(f"{commits}/{name}")
        if os.path.exists(f"{commits}/.{name}.crc"):
            os.remove(f"{commits}/.{name}.crc")
    assert run(spark, base, segments) == (rows, totals)


def test_segments_times_salts_are_never_broadcast(spark, tmp_path):
    """The files are far below the broadcast threshold; their rows times the salts may not be."""
    spark.range(1, 2001).selectExpr("id AS customer_id", "'A' AS segment").write.parquet(f"{tmp_path}/segments")
    arrive(spark, f"{tmp_path}/in", 0, [(i, i, i % 2100) for i in range(3000)])
    events, segments = spark.read.schema(P.EVENTS_SCHEMA).parquet(f"{tmp_path}/in"), spark.read.parquet(f"{tmp_path}/segments")
    rows = LATE.keyed_events(events, segments, "1 hour")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r.segment: r["count"] for r in rows.groupBy("segment").count().collect()} == {"A": 2900, "Unknown": 100}


def test_no_arrival_gives_no_row(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([], P.EVENTS_SCHEMA).write.parquet(f"{base}/in")
    segments = spark.createDataFrame([], "customer_id long, segment string")
    assert run(spark, base, segments) == ([], {})


def test_counts_and_late_events_are_all_events(spark):
    import __spark_entry__ as E
    from support import SF_SMALL
    rows = E.queries()["stream_segment_counts_late"](spark, SF_SMALL).collect()
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert sum(r.events + r.late_events for r in rows) == events and sum(r.late_events for r in rows) > events // 50
