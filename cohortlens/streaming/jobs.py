"""Structured Streaming jobs.

L1 ``stream_score``: continuous ingest of the upload landing folder ->
validate / quarantine -> score -> append.  Each micro-batch writes its good
and its rejected rows into folders named by the batch id with overwrite, so a
batch replayed after a failure replaces its own output (idempotent sink);
progress lives in the checkpoint folder.

L2 ``segment_counts``: events joined to the (static) customer segments,
counted per segment and event-time window with a watermark.  The static side
is joined without a hint, so the planner broadcasts it only below its size
threshold.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import distance as D
from ..operators import scoring as SCO
from ..operators import validate as V
from ..session import materialize
from ..sinks import versions
from ..sources import files

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def landing_stream(spark: SparkSession, folder: str, max_files: int = 8) -> DataFrame:
    """Lines of the CSV files arriving below ``folder`` (header lines included)."""
    return files.landing_lines(spark.readStream.option("maxFilesPerTrigger", max_files), folder)


def score_batch(norm: DataFrame, model: SCO.SegmentModel) -> tuple[DataFrame, DataFrame]:
    """Validated-and-flagged rows -> (scored good rows, rejected rows with their reason)."""
    good = V.typed(norm.filter(F.col("reject_reason").isNull()).drop("missing_columns"))
    scored = SCO.score(good, model).select(S.CUSTOMER_ID, "cluster", "segment", "confidence",
                                           "upload_label", "arrival_ts")
    bad = norm.filter(F.col("reject_reason").isNotNull()).select(
        *[F.col(f"{c}_raw").alias(S.PUBLIC_NAMES[c]) for c in S.INTERNAL_COLUMNS],
        "reject_reason", "upload_label", "arrival_ts")
    return scored, bad


def first_deliveries(batch: DataFrame, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows of uploads not taken yet, their ledger entries) of a micro-batch of upload rows.

    An upload is known by its content: the number of its lines and two sums of hashes of them,
    so a second name, or lines in another order, make no new upload.  Of equal uploads in one batch the
    first by name counts.
    """
    fields = [c for c in batch.columns if c not in files.UPLOAD_INFO]
    lines = [F.sum(F.xxhash64(F.lit(i), *fields).cast("decimal(38,0)")) for i in (1, 2)]
    content = batch.groupBy("source_file").agg(F.concat_ws("/", F.count(F.lit(1)), *lines).alias("content"))
    new = content.groupBy("content").agg(F.min("source_file").alias("source_file"))
    if ledger is not None:
        new = new.join(ledger.select("content").distinct(), "content", "left_anti")
    new = new.select("content", "source_file")
    # One row per file of the batch, at most the files of a trigger.
    return batch.join(new.select("source_file"), "source_file", "left_semi").select(*batch.columns), new


def run_stream_score(spark: SparkSession, folder: str, model: SCO.SegmentModel, out: str,
                     checkpoint: str, available_now: bool = True, ledger: str | None = None):
    """Start L1; with ``available_now`` it processes what has landed and stops.

    ``ledger``: a folder that records each upload's content by batch; an upload delivered
    again is not taken again.  A batch reads the entries of batches before it and
    overwrites its own, as it does with its rows, so a crash between sinks, ledger and
    checkpoint leaves every upload counted once.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if ledger is not None:
            batch = batch.persist()
            known = [spark.read.parquet(versions.path_of(ledger, n)) for n in versions.numbers(spark, ledger) if n < batch_id]
            before = functools.reduce(DataFrame.unionByName, known) if known else None
            rows, entries = first_deliveries(batch, before)
            versions.write(entries, ledger, batch_id)
        else:
            rows = batch
        # a file is whole in its micro-batch, so its header line is there
        norm = V.normalize(files.bind_by_name(rows)).withColumn(
            "reject_reason", V.reject_reason(F.col("missing_columns"))).persist()
        scored, bad = score_batch(norm, model)
        scored.write.mode("overwrite").parquet(f"{out}/scored/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")
        norm.unpersist()
        batch.unpersist()

    w = landing_stream(spark, folder).writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# ---------------------------------------------------------------------------
# K2 as a stream: centers that follow the data
# ---------------------------------------------------------------------------
CENTER_SCHEMA = "cluster int, weight double, center array<double>"


def update_centers(rows: DataFrame, cols: list[str], base: str, number: int, start: list[list[float]], decay: float) -> DataFrame:
    """Version ``number`` of the centers: those of the version before, moved by one batch.

    A center's weight decays, and the batch's rows nearest to it count one each:
    w' = decay * w + n, center' = (decay * w * center + sum of the rows) / w'.
    One aggregate over the batch; only k sums reach the driver.  Run again, a batch
    starts from the version below its number and replaces its own.
    """
    spark = rows.sparkSession
    state = versions.before(spark, base, number)
    now = {r.cluster: (r.weight, list(r.center)) for r in state.collect()} if state is not None else {
        j: (0.0, list(map(float, c))) for j, c in enumerate(start)}
    centers = [now[j][1] for j in sorted(now)]
    labelled = rows.withColumn("cluster", D.nearest_index(D.distance_array(cols, centers)))
    sums = {r[0]: r for r in labelled.groupBy("cluster").agg(
        F.count(F.lit(1)), *[F.sum(F.col(c).cast("double")) for c in cols]).collect()}
    out = []
    for j in sorted(now):
        weight, center = now[j][0] * decay, now[j][1]
        n = sums[j][1] if j in sums else 0
        total = [weight * c + (sums[j][2 + i] if n else 0.0) for i, c in enumerate(center)]
        out.append((j, weight + n, [t / (weight + n) for t in total] if weight + n > 0 else center))
    return versions.write(spark.createDataFrame(out, CENTER_SCHEMA).coalesce(1), base, number)


def run_stream_kmeans(rows: DataFrame, cols: list[str], start: list[list[float]], base: str, checkpoint: str, decay: float = 0.9):
    """Start the streaming k-means: one version of the centers per micro-batch below ``base``."""
    w = rows.writeStream.foreachBatch(lambda batch, number: update_centers(batch, cols, base, number, start, decay) and None)
    return w.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_stream(spark: SparkSession, path: str, max_files: int | None = 1) -> DataFrame:
    """Parquet events below ``path`` (a file or a folder); ``max_files`` None: all that has arrived in one trigger.

    The source takes files in order of modification time.  Files written by parallel
    tasks are therefore in no order of event time: in append mode read them in one trigger,
    or the watermark of a later file drops the events of an earlier one.
    """
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("recursiveFileLookup", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def segment_counts(events: DataFrame, segments: DataFrame, window: str = "1 hour",
                   watermark: str = "1 hour") -> DataFrame:
    """Events per customer segment and event-time window (stream-static join, watermark)."""
    ev = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    seg = segments.select(F.col(S.CUSTOMER_ID).cast("long").alias("_cid"), "segment")
    j = ev.join(seg, ev.user_id + 1 == seg["_cid"], "inner")
    return (j.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window), "segment")
            .agg(F.count(F.lit(1)).alias("events")))


def static_segments(segments: DataFrame) -> DataFrame:
    """The static side of the stream join, written once: no micro-batch derives it again.

    The join carries no hint, so the planner broadcasts it only below its size threshold.
    """
    return materialize(segments.select(S.CUSTOMER_ID, "segment"), "stream-segments")


def run_segment_counts(events: DataFrame, segments: DataFrame, out: str, checkpoint: str, mode: str = "complete"):
    """Start L2.  ``complete`` rewrites the whole table per batch (used for the check);
    ``append`` emits each window once the watermark passes it."""
    counts = segment_counts(events, segments)
    flat = counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                         F.col("window.end").cast("timestamp_ntz").alias("window_end"), "segment", "events")
    if mode == "complete":
        def write_batch(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        w = flat.writeStream.outputMode("complete").foreachBatch(write_batch)
    else:
        w = flat.writeStream.outputMode("append").format("parquet").option("path", out)
    return w.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
