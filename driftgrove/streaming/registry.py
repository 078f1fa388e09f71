"""The registry of sources as keyed streaming state.

Each source has a state of its own: the batches of the window that it is in. A micro-batch touches the
states of its own sources only, and of those that leave the window: a timer of each source, in the
event time of batch numbers, ends its oldest batch when the stream has come far enough. What changes is
appended to a table of changes, from which the registry and the sources at work are read.

A batch may come in several micro-batches, as long as no row of a later one has come in an earlier one.
Rows of an older batch are late and refused: they appear among the changes without ``as_of``, or, if
older still, are counted by Spark (``numRowsDroppedByWatermark``). That batches follow each other
without a gap is checked by the engine, not here.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

CHANGES = "source_id string, last_batch long, batches long, as_of long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds of event time from one batch to the next.
STEP = 1000


class Held(StatefulProcessor):
    """The state of one source: ``recent``, its batches that may still leave the window, and ``older``, how many others it is in.

    Without a window ``recent`` is the last batch alone, so a state never grows; with one, a source that
    has left has no state.
    """

    def __init__(self, window: int | None):
        self.window = window

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "recent array<long>, older long")

    def read(self) -> tuple[list[int], int]:
        got = self.held.get() if self.held.exists() else None
        return (list(got[0]), got[1]) if got else ([], 0)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        recent, older = self.read()
        reached = timerValues.getCurrentWatermarkInMs() // STEP
        sent = {r.batch_index for r in rows}
        yield from (Row(source_id=key[0], last_batch=b, batches=None, as_of=None) for b in sorted(sent) if b < reached)
        new = {b for b in sent if b >= reached}.difference(recent)
        if not new:
            return
        had_timer = bool(recent)
        recent = sorted(new.union(recent))
        if self.window is None:
            recent, older = recent[-1:], older + len(recent) - 1
        elif not had_timer:
            self.handle.registerTimer((recent[0] + self.window) * STEP)
        self.held.update((recent, older))
        yield Row(source_id=key[0], last_batch=recent[-1], batches=older + len(recent), as_of=recent[-1])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Drops the batches that have left: the watermark of batch b is b steps, and b pushes out b - window."""
        recent, older = self.read()
        if not recent:
            return
        reached = timerValues.getCurrentWatermarkInMs() // STEP
        left = [b for b in recent if b > reached - self.window]
        if left:
            self.handle.registerTimer((left[0] + self.window) * STEP)
            self.held.update((left, older))
        else:
            self.held.clear()
        yield Row(source_id=key[0], last_batch=recent[-1], batches=len(left), as_of=max(reached, recent[-1]))

    def close(self) -> None:
        pass


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each source and batch once in an Arrow batch, before the exchange: a source that is sent very often isn't a hot key after that."""
    for b in batches:
        yield from pa.Table.from_batches([b]).group_by(b.schema.names).aggregate([]).to_batches()


@contextmanager
def _provider(spark: SparkSession):
    """State in RocksDB for queries started meanwhile; they keep it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def changes(stream: DataFrame, window: int | None = None) -> DataFrame:
    """source_id, last_batch, batches, as_of (the batch that the stream had reached): a row for each change of a source, of ``stream`` with source_id and batch_index.

    ``batches`` is of those in the window, 0 when the source has left it; with no window, of all. Rows
    without source_id or batch_index are passed over; other columns and repeated rows don't matter.
    Batches are numbered from 0: the first watermark is 0, so batch b's time is b + 1 steps and its watermark b.
    """
    if window is not None and window < 1:
        raise ValueError("a window holds one batch or more")
    pairs = stream.select("source_id", F.col("batch_index").cast("long").alias("batch_index")).filter("source_id IS NOT NULL AND batch_index IS NOT NULL")
    timed = pairs.mapInArrow(_once, pairs.schema).withColumn("at", F.timestamp_millis((F.col("batch_index") + 1) * STEP)).withWatermark("at", f"{STEP} milliseconds")
    return timed.groupBy("source_id").transformWithState(Held(window), CHANGES, "append", "eventtime")


def start(stream: DataFrame, path: str, checkpoint: str, window: int | None = None, once: bool = True) -> StreamingQuery:
    """Appends the changes to the table at ``path``, each exactly once; with ``once`` it ends when what is there has been read."""
    with _provider(stream.sparkSession):
        writer = changes(stream, window).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def registry(spark: SparkSession, path: str) -> DataFrame:
    """source_id, last_batch, batches of the sources in the window, each by its last change.

    Of two changes at the same batch the later one is that with the larger last batch, or, if that is the same, with fewer batches.
    """
    rows = spark.read.schema(CHANGES).parquet(path).filter("as_of IS NOT NULL")
    last = rows.groupBy("source_id").agg(F.max(F.struct("as_of", "last_batch", (-F.col("batches")).alias("less"))).alias("c"))
    return last.select("source_id", "c.last_batch", (-F.col("c.less")).alias("batches")).filter("batches > 0")


def late(spark: SparkSession, path: str) -> DataFrame:
    """source_id, batch_index of what was refused as late."""
    return spark.read.schema(CHANGES).parquet(path).filter("as_of IS NULL").select("source_id", F.col("last_batch").alias("batch_index")).distinct()


def source_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files with source_id and batch_index, so many per micro-batch, in the order in which they were written."""
    return spark.readStream.schema("source_id string, batch_index long").option("maxFilesPerTrigger", files_per_batch).parquet(path)
