"""Running a stream over what is there now, with restartable file sinks."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from wardlight.sources.files import exists


class ProgressLog(StreamingQueryListener):
    """Progress of every batch of one run; the query itself remembers the last hundred only."""

    def __init__(self):
        self.by_run: dict[str, dict] = {}
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.by_run.setdefault(str(progress.runId), {})[progress.batchId] = progress

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def of(self, run: str, wait: float = 60.0) -> list:
        """Progress of the batches of a run that has ended, once the last event has arrived."""
        if not self._end(run).wait(wait):
            raise TimeoutError("the end of the stream was not reported")
        return [progress for _, progress in sorted(self.by_run.get(run, {}).items())]


def run_available(df: DataFrame, write_batch, checkpoint: str, mode: str = "append",
                  timeout: float | None = None):
    """Process everything available in micro-batches, then stop; returns the progress of every batch.

    The checkpoint is the watermark of the source: a failed batch is replayed
    with the same number, and batch folders make the replay harmless. There is no
    limit on the time unless ``timeout`` (seconds) sets one.
    """
    log = ProgressLog()
    streams = df.sparkSession.streams
    streams.addListener(log)
    try:
        query = (df.writeStream.outputMode(mode).foreachBatch(write_batch)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            query.stop()
            raise TimeoutError("stream did not finish")
        return log.of(str(query.runId))
    finally:
        streams.removeListener(log)


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def write_once(df: DataFrame, path: str, batch_id: int, by: str | None = None) -> None:
    """Write one batch to its own folder; writing it again replaces it. Rows of one ``by`` meet first, so files stay few."""
    if by:
        writer = df.hint("rebalance", by).write.partitionBy(by)
    else:
        writer = df.write
    writer.mode("overwrite").parquet(batch_folder(path, batch_id))


def read_batches(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """All batches written so far, or None."""
    if not exists(spark, path):
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def dropped_late_rows(progress) -> int:
    """Rows that stateful operators dropped as later than the watermark, as they saw them (see ``intake.count_days``)."""
    return sum(int(op.numRowsDroppedByWatermark) for p in progress for op in p.stateOperators)
