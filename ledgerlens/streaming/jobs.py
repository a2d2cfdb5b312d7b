"""Structured Streaming jobs: validation, per-account features, windows, duplicates, delayed labels.

Each takes and returns streaming frames; ``drain`` runs one to the end of what its source has.
"""

import threading
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ledgerlens.sources.scratch import shared_dir


def drain(stream: DataFrame, checkpoint: str | None = None, path: str | None = None, fmt: str = "parquet"):
    """Write a stream to files until its source has no more, and return (rows written, query).

    With the same checkpoint a second run takes up where the first ended.
    """
    base = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    path, checkpoint = path or f"{base}/out", checkpoint or f"{base}/checkpoint"
    query = stream.writeStream.format(fmt).option("path", path).option("header", True).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("header", True).format(fmt).load(path), query


def _late(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, account: str) -> Iterator[pd.DataFrame]:
    batch = pd.concat(list(frames), ignore_index=True).sort_values("event_id")
    step = batch["step"].to_numpy(np.int64)
    newest = np.maximum.accumulate(np.concatenate((state.get[:1] if state.exists else [-(1 << 62)], step)))
    state.update((int(newest[-1]),))
    batch["hours_late"] = newest[:-1] - step
    yield batch.loc[batch["hours_late"] > 0, ["event_id", account, "step", "hours_late"]]


def late_events(events: DataFrame, account: str) -> DataFrame:
    """Events ``(event_id, account, step)`` with a lower step than an earlier one of their account, by
    event_id in a batch and by arrival between batches, and how late they are."""
    out = f"event_id long, {account} long, step long, hours_late long"
    return events.groupBy(account).applyInPandasWithState(partial(_late, account=account), out, "newest long", "append", GroupStateTimeout.NoTimeout)


def paired(features: DataFrame) -> DataFrame:
    """One row an event from the rows of its two roles."""
    names = [c for c in features.columns if c not in ("role", "account", "event_id")]
    at = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{c}")
    return features.groupBy("event_id").agg(*[at(r, c) for r in ("sender", "dest") for c in names])


def activity(events: DataFrame, time: str = "ts", length: str = "6 hours", slide: str | None = None, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Events by tumbling window, or by sliding ones with ``slide``; a window is final once the watermark has passed its end."""
    w = events.withWatermark(time, late).groupBy(F.window(time, length, slide), by)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events with less than ``gap`` between neighbours; late ones join or merge runs until
    the watermark has passed their end."""
    w = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def once(events: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Replays of a key within the watermark are dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def delayed_labels(predictions: DataFrame, labels: DataFrame, key: str, longest: str = "2 hours") -> DataFrame:
    """Predictions ``(key, ts, ...)`` with labels ``(label_key, label_ts, ...)`` that come up to ``longest`` later."""
    p = predictions.withWatermark("ts", "1 hour")
    t = labels.withWatermark("label_ts", "1 hour")
    return p.join(t, F.expr(f"{key} = label_key AND label_ts >= ts AND label_ts <= ts + INTERVAL {longest}"), "leftOuter")


def write_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch to the partition of its number, in place of what is there.

    After a crash between a batch's write and its entry in the checkpoint, Spark runs the batch again with
    the same rows and the same number, so every row is there once. Read it with ``read_batches``.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema.add("batch_id", "long")).parquet(path)


PROGRESS = "query string, batch long, n_rows long, ms long, state_rows long, watermark string"


class ProgressTable(StreamingQueryListener):
    """Writes the progress of every batch of every query of a session to a table, while they run.

    Use it as a context: at its end it waits for the queries that have begun in it, and writes what is left.
    """

    #: Rows that are held before they are written.
    HELD = 500

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.rows = spark, path, []
        self.lock, self.open, self.quiet = threading.Lock(), set(), threading.Event()
        self.quiet.set()

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.open.add(event.runId)
            self.quiet.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = sum(s.numRowsTotal for s in p.stateOperators)
        with self.lock:
            self.rows.append((str(p.id), p.batchId, p.numInputRows, p.durationMs.get("triggerExecution"), state, p.eventTime.get("watermark")))
            full = len(self.rows) >= self.HELD
        if full:
            self.write()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.open.discard(event.runId)
            if not self.open:
                self.quiet.set()

    def write(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        """All progress; a batch without work may report itself more than once, of which the last counts."""
        self.write()
        rows = self.spark.read.schema(PROGRESS).parquet(self.path)
        return rows.groupBy("query", "batch").agg(F.max_by(F.struct("n_rows", "ms", "state_rows", "watermark"), F.struct("n_rows", "watermark")).alias("r")).select("query", "batch", "r.*")

    def __enter__(self) -> "ProgressTable":
        self.spark.createDataFrame([], PROGRESS).write.mode("append").parquet(self.path)
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.quiet.wait(60)
        self.spark.streams.removeListener(self)
        self.write()


def progress(query: StreamingQuery) -> list[dict]:
    """Batch, input rows and duration of a query's last batches, of which Spark keeps a hundred; see ``ProgressTable``."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["durationMs"].get("triggerExecution")} for p in query.recentProgress]
