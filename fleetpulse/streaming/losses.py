"""Losses of streaming queries for the whole of their run.

Spark keeps the last hundred progress reports of a query. A listener appends every
report's counts to a table, a few reports a file, so totals are exact however long a
query runs, and stay when the driver goes.
"""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = "at string, query string, id string, run_id string, batch bigint, input_rows bigint, dropped_rows bigint"


class LossRecorder(StreamingQueryListener):
    """Appends (input rows, rows behind the watermark) of every micro-batch to the table in ``folder``.

    Reports are written ``every`` so many, and all of a query's when it ends.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 64):
        self.spark, self.folder, self.every = spark, folder, every
        self.lock, self.held = threading.Lock(), []
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        read = p.numInputRows
        with self.lock:
            self.held.append((p.timestamp, p.name, str(p.id), str(p.runId), p.batchId, read, dropped))
            if len(self.held) >= self.every:
                self._write()

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self._write()
        self.ended[str(event.runId)].set()

    def _write(self) -> None:
        if self.held:
            self.spark.createDataFrame(self.held, PROGRESS).coalesce(1).write.mode("append").parquet(self.folder)
            self.held = []

    def wait_for(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until all reports of an ended query are in the table."""
        if not self.ended[str(query.runId)].wait(seconds):
            raise TimeoutError(f"no end of query {query.name} within {seconds} s")


def record_losses(spark: SparkSession, folder: str, every: int = 64) -> LossRecorder:
    """Start recording all queries of a session; ``spark.streams.removeListener`` ends it."""
    recorder = LossRecorder(spark, folder, every)
    spark.streams.addListener(recorder)
    return recorder


def recorded_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Observations per micro-batch, ``stream/input_rows`` and ``stream/dropped_rows``: the batch's own count (raw) and the
    total since the query first started (total), across its restarts."""
    rows = spark.read.schema(PROGRESS).parquet(folder)
    # A batch that a restart runs again reports once more: its last report counts.
    last = rows.groupBy("query", "id", "batch").agg(F.max_by(F.struct("at", "input_rows", "dropped_rows"), F.struct("at", "input_rows")).alias("p"))
    so_far = Window.partitionBy("id", "name").orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = F.array(F.struct(F.lit("stream/dropped_rows").alias("name"), F.col("p.dropped_rows").alias("raw")),
                   F.struct(F.lit("stream/input_rows").alias("name"), F.col("p.input_rows").alias("raw")))
    each = last.select("query", "id", "batch", F.to_timestamp("p.at").alias("ts"), F.inline(both))
    return each.select("ts", "name", F.create_map(F.lit("query"), F.col("query")).alias("labels"), F.lit("gauge").alias("kind"),
                       F.lit("count").alias("unit"), "raw", "batch", F.sum("raw").over(so_far).alias("total"))
