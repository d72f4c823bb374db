"""Streaming queries (run with an available-now trigger, then read back from their sinks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import scaling as SC
from ..operators import scoring as SCO
from ..session import fresh_path
from ..sources import adapter
from ..sources.tables import read_table, table_path
from ..streaming import jobs as P
from ..streaming import late as LATE
from .catalog import register
from .io_queries import write_landing


@register("stream_score")
def q_stream_score(spark, sf_dir):
    """L1: landing folder -> validate/quarantine -> score -> idempotent per-batch sink."""
    model = SCO.fixed_center_model(SC.fit_standard(adapter.customers(spark, sf_dir)))
    folder = write_landing(spark, sf_dir)
    out = fresh_path(spark, "stream_score")
    q = P.run_stream_score(spark, folder, model, out, fresh_path(spark, "stream_score_ckpt"))
    q.awaitTermination()
    return spark.read.parquet(f"{out}/scored").drop("batch").select(
        S.CUSTOMER_ID, "cluster", "segment", "upload_label", "arrival_ts")


@register("stream_segment_counts")
def q_stream_segment_counts(spark, sf_dir):
    """L2: events per rule segment and hour (watermarked stream-static join, complete mode)."""
    segments = P.static_segments(adapter.segmented(spark, sf_dir))
    out = fresh_path(spark, "segment_counts")
    events = P.events_stream(spark, table_path(sf_dir, "events"))
    q = P.run_segment_counts(events, segments, out, fresh_path(spark, "segment_counts_ckpt"))
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_segment_counts_append")
def q_stream_segment_counts_append(spark, sf_dir):
    """L2 in append mode: a window comes out once, when the watermark has passed it.

    What parallel tasks wrote into a day's folder is read in one trigger, so no event is late.  One event two days later closes the last windows; its own window stays open.
    """
    folder = fresh_path(spark, "events")
    events = read_table(spark, sf_dir, "events").select(*P.EVENTS_SCHEMA.fieldNames())
    events.write.parquet(f"{folder}/day=1")
    last = events.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.min("user_id").alias("user_id"))
    end = last.select(F.lit(-1).cast("long").alias("event_id"), "ts", "user_id", F.lit("end").alias("event_type"),
                      F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))
    out, ckpt = fresh_path(spark, "segment_counts"), fresh_path(spark, "segment_counts_ckpt")
    segments = P.static_segments(adapter.segmented(spark, sf_dir))
    for step in range(2):  # the events, then the closing one: a second run goes on from the checkpoint
        P.run_segment_counts(P.events_stream(spark, folder, max_files=None), segments, out, ckpt, mode="append").awaitTermination()
        if step == 0:
            end.write.parquet(f"{folder}/day=2")
    return spark.read.parquet(out)


@register("stream_score_redelivered")
def q_stream_score_redelivered(spark, sf_dir):
    """L1 with the ledger: every third upload comes a second time under another name, and counts once."""
    model = SCO.fixed_center_model(SC.fit_standard(adapter.customers(spark, sf_dir)))
    folder, out = write_landing(spark, sf_dir), fresh_path(spark, "stream_score")
    ckpt, ledger = fresh_path(spark, "stream_score_ckpt"), fresh_path(spark, "ledger")
    P.run_stream_score(spark, folder, model, out, ckpt, ledger=ledger).awaitTermination()
    write_landing(spark, sf_dir, folder, "20240102", "again", F.col("c_nationkey") % 3 == 0)
    P.run_stream_score(spark, folder, model, out, ckpt, ledger=ledger).awaitTermination()
    return spark.read.parquet(f"{out}/scored").drop("batch").select(
        S.CUSTOMER_ID, "cluster", "segment", "upload_label", "arrival_ts")


#: Arrivals of ``stream_kmeans`` (customers by id), and what a center's weight keeps of one batch.
ARRIVALS, DECAY = 5, 0.5


@register("stream_kmeans")
def q_stream_kmeans(spark, sf_dir):
    """K2 as a stream: customers arrive in five batches; the centers after each of them."""
    cust = adapter.customers(spark, sf_dir).select(S.CUSTOMER_ID, *[F.col(c).cast("double").alias(c) for c in S.FEATURES])
    folder, base, ckpt = (fresh_path(spark, f"stream_kmeans_{n}") for n in ("in", "model", "ckpt"))
    start = [[x, y] for _, x, y in S.FIXED_CENTERS]
    for day in range(ARRIVALS):  # what has arrived is one micro-batch, whatever the number of its files
        cust.filter(F.col(S.CUSTOMER_ID) % ARRIVALS == day).write.parquet(f"{folder}/day={day}")
        rows = spark.readStream.schema(cust.schema).option("recursiveFileLookup", True).parquet(folder)
        P.run_stream_kmeans(rows, S.FEATURES, start, base, ckpt, DECAY).awaitTermination()
    out = spark.read.parquet(base)
    return out.select(F.col("version").cast("int").alias("version"), "cluster", F.round("weight", 6).alias("weight"),
                      *[F.round(F.col("center")[i], 6).alias(c) for i, c in enumerate(S.FEATURES)])


#: Spans of event time of ``stream_segment_counts_late``; an event arrives with its span or up to two later, so in eight arrivals.
SPANS = 6


@register("stream_segment_counts_late")
def q_stream_segment_counts_late(spark, sf_dir):
    """L2 with late data: eight arrivals out of order of event time, each a micro-batch of its own run.

    Every eleventh event arrives one span late and every 37th two.  One event two days after the last closes all windows;
    its own stays open.  Counts and late events together are all events.
    """
    folder, out, ckpt = (fresh_path(spark, f"late_{n}") for n in ("in", "out", "ckpt"))
    events = read_table(spark, sf_dir, "events").select(*P.EVENTS_SCHEMA.fieldNames())
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    segments = P.static_segments(adapter.segmented(spark, sf_dir))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    lo, hi = micros(F.lit(first)), micros(F.lit(last))
    span = F.floor((micros(F.col("ts")) - lo) * SPANS / (hi - lo + 1))
    arrival = span + F.when(F.col("event_id") % 37 == 0, 2).when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    closing = events.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.min("user_id").alias("user_id")).select(
        F.lit(-1).cast("long").alias("event_id"), "ts", "user_id", F.lit("end").alias("event_type"),
        F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))
    for day in range(SPANS + 3):
        came = closing if day == SPANS + 2 else events.filter(arrival == day)
        came.write.parquet(f"{folder}/day={day}")
        LATE.run_late_counts(P.events_stream(spark, folder, max_files=None), segments, out, ckpt).awaitTermination()
    return LATE.window_totals(LATE.read_out(spark, out))
