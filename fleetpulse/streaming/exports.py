"""Exports that go on past a failing sink, and lose nothing.

A failed micro-batch is kept as rows of a dead-letter table and given to the sink again
after later batches have gone through, or by :func:`replay_dead_letters`. Every tick
records the total of failures so far, 0 included, so the series stays alive and
a rate over it reads 0 while all is well.

The folder holds ``rows/batch=N`` (the failed rows), ``done/batch=N`` (given back, with
its tick) and ``ticks/batch=N`` (the totals). All three are overwritten by batch, so a
batch that Spark replays after a restart is the same batch again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

Sink = Callable[[DataFrame, int], None]
TICK = "at timestamp, tick bigint, failures bigint, pending bigint, error string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Batches with a finished folder; one row of a directory listing each."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("batch=") and _exists(spark, f"{folder}/{n}/_SUCCESS"))


def pending_batches(spark: SparkSession, dead_letters: str) -> list[int]:
    """Failed batches that no sink has taken yet."""
    done = set(_batches(spark, f"{dead_letters}/done"))
    return [b for b in _batches(spark, f"{dead_letters}/rows") if b not in done]


def export_ticks(spark: SparkSession, dead_letters: str) -> DataFrame:
    """One row per tick: at, tick, failures (so far), pending, error."""
    if not _batches(spark, f"{dead_letters}/ticks"):
        return spark.createDataFrame([], TICK)
    return spark.read.schema(TICK).parquet(f"{dead_letters}/ticks").select(*[f.split()[0] for f in TICK.split(", ")])


def failure_counter(spark: SparkSession, dead_letters: str, sink: str) -> DataFrame:
    """The ticks as observations of the counter ``exporter/sink/export_failures``."""
    return export_ticks(spark, dead_letters).select(
        F.col("at").alias("ts"), F.lit("exporter/sink/export_failures").alias("name"), F.create_map(F.lit("sink"), F.lit(sink)).alias("labels"),
        F.lit("counter").alias("kind"), F.lit("count").alias("unit"), F.col("failures").alias("raw"), "tick")


class DeadLetters:
    """Sends batches to a sink, keeps those it refuses and counts."""

    def __init__(self, spark: SparkSession, folder: str, sink: Sink, on_failure: Callable[[int, Exception], None] | None = None):
        self.spark, self.folder, self.sink, self.on_failure = spark, folder, sink, on_failure
        # a tick that Spark runs again starts from the total before it
        self.totals = {r.tick: r.failures for r in export_ticks(spark, folder).select("tick", "failures").collect()}
        self.pending = set(pending_batches(spark, folder))

    def _send(self, rows: DataFrame, batch_id: int) -> Exception | None:
        try:
            self.sink(rows, batch_id)
        except Exception as error:  # noqa: BLE001  whatever a sink raises is a failed export
            if self.on_failure is not None:
                self.on_failure(batch_id, error)
            return error
        return None

    def tick(self, batch: DataFrame, batch_id: int) -> None:
        failures = max((n for t, n in self.totals.items() if t < batch_id), default=0)
        error = self._send(batch, batch_id)
        if error is not None:
            failures += 1
            batch.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch_id}")
            self.pending.add(batch_id)
        else:
            failures += self.replay(batch_id, before=batch_id)
        self.totals[batch_id] = failures
        row = (datetime.now(timezone.utc), batch_id, failures, len(self.pending), None if error is None else str(error)[:500])
        self.spark.createDataFrame([row], TICK).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ticks/batch={batch_id}")

    def replay(self, tick: int, before: int | None = None) -> int:
        """Give kept batches to the sink again, oldest first, until one fails; returns the failures."""
        for batch_id in sorted(b for b in self.pending if before is None or b < before):
            rows = self.spark.read.parquet(f"{self.folder}/rows/batch={batch_id}")
            if self._send(rows, batch_id) is not None:
                return 1
            self.spark.createDataFrame([(tick,)], "tick bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/done/batch={batch_id}")
            self.pending.discard(batch_id)
        return 0


def replay_dead_letters(spark: SparkSession, dead_letters: str, sink: Sink) -> list[int]:
    """Give all kept batches to ``sink``, in order; returns those still pending."""
    letters = DeadLetters(spark, dead_letters, sink)
    letters.replay(max(letters.totals, default=-1) + 1)
    return sorted(letters.pending)


def tolerant_export(df: DataFrame, sink: Sink, dead_letters: str, every="10 seconds", *, checkpoint: str, name: str = "export",
                    drain: bool = False, on_failure: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """Push a stream to ``sink`` and go on when it fails; ``sink`` gets each batch id once successfully, or again after a restart."""
    letters: dict[str, DeadLetters] = {}

    def push(batch: DataFrame, batch_id: int) -> None:
        if "held" not in letters:  # in the session of the query, once it runs
            letters["held"] = DeadLetters(batch.sparkSession, dead_letters, sink, on_failure)
        batch.persist()
        try:
            letters["held"].tick(batch, batch_id)
        finally:
            batch.unpersist()

    writer = df.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(push)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)
    return writer.start()
