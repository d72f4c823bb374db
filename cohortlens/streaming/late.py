"""L2 with late data: windowed counts whose state closes by event-time timers, late events kept apart.

Each event goes to the state of its (segment, salt).  A state holds one count per open
window and a timer at the window's end; when the watermark passes it, the count comes out once
and leaves the state, so the state is as large as the windows that are open.  An event whose window
has ended by the watermark is late: it comes out as it is and changes no count.  So counts and late events
together are all events.

Salts spread a segment, and a user who has most of the events, over tasks; the reader adds the salts' counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schema as S
from ..session import ship_package

#: Tasks that one segment's events, or one user's, are spread over.
SALTS = 8
WINDOW_MS = 3_600_000
#: A row per closed (segment, salt, window) with its count, or per late event with its id (count 1).
OUT_SCHEMA = "segment string, start_ms long, event_id long, late boolean, n long"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class WindowCounts(StatefulProcessor):
    """Counts per window of one key; see the module's first lines."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start_ms long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            late = part["start_ms"] + WINDOW_MS <= mark
            if late.any():
                yield part.loc[late, ["start_ms", "event_id"]].assign(segment=key[0], late=True, n=1)[
                    ["segment", "start_ms", "event_id", "late", "n"]]
            for start, n in part.loc[~late, "start_ms"].value_counts().items():
                at = (int(start),)
                known = self.open.containsKey(at)
                if not known:
                    self.handle.registerTimer(int(start) + WINDOW_MS)
                self.open.updateValue(at, ((self.open.getValue(at)[0] if known else 0) + int(n),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - WINDOW_MS
        n = self.open.getValue((start,))[0]
        self.open.removeKey((start,))
        yield pd.DataFrame({"segment": [key[0]], "start_ms": [start], "event_id": [None], "late": [False], "n": [n]}).astype(
            {"event_id": "Int64"})

    def close(self) -> None:
        pass


def keyed_events(events: DataFrame, segments: DataFrame, delay: str) -> DataFrame:
    """(segment, salt, start_ms, event_id) of every event; users of no segment count as 'Unknown'.

    The watermark is taken of all events before the join.  ``ts`` goes no further: Spark drops rows with a
    watermarked column below the watermark before they reach the state, and those are the ones to be kept.
    """
    ts = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id").withWatermark("ts", delay)
    ms = F.unix_millis("ts")
    ev = ts.select("event_id", "user_id", (ms - F.pmod(ms, F.lit(WINDOW_MS))).alias("start_ms"),
                   F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int").alias("salt"))
    seg = segments.select((F.col(S.CUSTOMER_ID).cast("long") - 1).alias("user_id"), "segment",
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # The planner's size of ``seg`` is that of its files, without the salts: it would broadcast SALTS rows per customer.
    both = ev.join(seg.hint("merge"), ["user_id", "salt"], "left")
    return both.select(F.coalesce("segment", F.lit("Unknown")).alias("segment"), "salt", "start_ms", "event_id")


def run_late_counts(events: DataFrame, segments: DataFrame, out: str, checkpoint: str, delay: str = "1 hour"):
    """Start the counts over what has arrived.  A micro-batch writes its rows to a folder named by its
    id and overwrites it when it runs again, so a replay leaves nothing twice."""
    spark = events.sparkSession
    ship_package(spark)
    rows = keyed_events(events, segments, delay).groupBy("segment", "salt").transformWithStateInPandas(
        WindowCounts(), OUT_SCHEMA, "Append", "EventTime")

    def write_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # timers and map state need it; a started query keeps the setting it began with
    try:
        return (rows.writeStream.outputMode("append").foreachBatch(write_batch)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def read_out(spark: SparkSession, out: str) -> DataFrame:
    """What the batches wrote; no row before the first batch."""
    spark.createDataFrame([], OUT_SCHEMA).write.mode("overwrite").parquet(f"{out}/batch=-1")
    return spark.read.schema(OUT_SCHEMA).parquet(out)


def window_totals(rows: DataFrame) -> DataFrame:
    """Per segment and window the events counted in time, and those that came late."""
    start = F.timestamp_millis("start_ms").cast("timestamp_ntz")
    return rows.groupBy("segment", "start_ms").agg(
        F.coalesce(F.sum(F.when(~F.col("late"), F.col("n"))), F.lit(0)).alias("events"),
        F.coalesce(F.sum(F.when(F.col("late"), F.col("n"))), F.lit(0)).alias("late_events")).select(
        "segment", start.alias("window_start"), (start + F.expr("INTERVAL 1 HOUR")).alias("window_end"), "events", "late_events")
