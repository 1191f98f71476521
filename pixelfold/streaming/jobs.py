"""Current state of every job from a stream of status events, with timers for jobs that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Stateful processors with timers need this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Before all events.
NEVER = -1 << 62


class JobStatus(StatefulProcessor):
    """Keeps a job's latest event; an event-time timer fires when none follows for a while.

    Works on rows, as most jobs have few events in a batch: a frame for every job costs more than its events.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "updated long, event_id long, status string, events long, late long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.latest.get()
        updated, event, status, events, late = before or (NEVER, NEVER, None, 0, 0)
        seen = updated
        for row in rows:
            t, e = (NEVER if v is None else v for v in (row["us"], row["event_id"]))
            # out of order against what earlier batches have seen
            late += t < seen
            events += 1
            if (t, e) > (updated, event):
                updated, event, status = t, e, row["status"]
        if before is None or updated != seen:
            if before is not None:
                self.handle.deleteTimer(seen // 1000 + self.idle_ms)
            self.handle.registerTimer(updated // 1000 + self.idle_ms)
        self.latest.update((updated, event, status, events, late))
        yield Row(job_id=key[0], us=updated, status=status, events=events, late=late, idle=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        updated, _, status, events, late = self.latest.get()
        yield Row(job_id=key[0], us=updated, status=status, events=events, late=late, idle=True)

    def close(self) -> None:
        pass


def stream_job_status(events: DataFrame, idle="2 days", delay="1 day") -> DataFrame:
    """A row for every change of a job's state: (job_id, updated, status, events, late, idle).

    ``events``: ``job_id, ts, event_id, status``.  The latest event counts, ties
    by the larger ``event_id``; ``late`` counts events older than one already
    seen in an earlier batch.  When the watermark, ``delay`` behind the latest
    event of all jobs, passes ``idle`` after a job's last event, a row with
    ``idle`` follows; a later event ends that.  Events behind the watermark are
    dropped.  The state of a job is one event.  Needs ``STATE_STORE`` as the
    session's state store.
    """
    ms = pd.Timedelta(idle) // pd.Timedelta(milliseconds=1)
    kind = events.schema["job_id"].dataType.simpleString()
    rows = events.select("job_id", "ts", "event_id", "status", F.unix_micros("ts").alias("us")).withWatermark("ts", delay)
    states = rows.groupBy("job_id").transformWithState(
        JobStatus(int(ms)), f"job_id {kind}, us long, status string, events long, late long, idle boolean",
        outputMode="Update", timeMode="EventTime")
    return states.select("job_id", F.timestamp_micros("us").alias("updated"), "status", "events", "late", "idle")


def latest_states(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the stream over everything available and return the last row of every job."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/n={number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    written = spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).option("recursiveFileLookup", "true").parquet(path)
    # a timer fires after the rows of its batch
    last = F.max_by(F.struct(*stream.columns), F.struct("batch", "idle"))
    return written.groupBy("job_id").agg(last.alias("row")).select("row.*")
