"""Feeding the engine from Structured Streaming.

The tree is one state that every source may touch, so a stream is handled a micro-batch at a time.
After each, the engine is saved as a new version and the pointer file moves to it: a batch that is
delivered again finds itself done, and one that fails leaves the version before in force. A version
writes what the batch has changed or added and refers to the tables of earlier versions for the rest;
tables that none of the last KEPT versions refers to are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftgrove.config import Config
from driftgrove.engine import Engine
from driftgrove.tables import numbered


#: Versions that can be loaded: the one in force and those before it.
KEPT = 2


class StreamedEngine:
    """An engine under ``path``: versions ``v0``, ``v1`` ... and ``pointer``, the last one that is complete."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, rebuild_mode: str = "full"):
        self.spark, self.path, self.config, self.mode = spark, path, config or Config(), rebuild_mode

    def version(self) -> int:
        """The last complete version, or -1."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(f"{self.path}/pointer")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return -1
        return max((json.loads(r[0])["version"] for r in self.spark.read.text(f"{self.path}/pointer").collect()), default=-1)

    def engine(self) -> Engine:
        return Engine.load(self.spark, f"{self.path}/v{self.version()}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """``batch``: source_id, tokens and, if there, source_index; empty batches count as batches without change, those before the first source aren't counted."""
        done = self.version()
        if batch_id <= done:
            return
        rows = batch if "source_index" in batch.columns else numbered(batch, ["source_id"], "source_index", 0)
        if done < 0:
            if not rows.limit(1).count():
                return
            engine = Engine(self.spark, self.config, self.mode)
            engine.build_baseline(rows, batch_id)
        else:
            engine = self.engine()
            engine.process_batch(rows, batch_id)
        engine.save(f"{self.path}/v{batch_id}")
        self.spark.createDataFrame([(json.dumps({"version": batch_id}),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/pointer")
        self.sweep()

    def sweep(self) -> list[str]:
        """Deletes the tables that no kept version refers to, and the versions that aren't kept; returns their folders.

        Versions above the pointer are of batches that never ended and go too. A sweep that dies is repeated by the next.
        """
        hadoop, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = hadoop.Path(self.path)
        files = at.getFileSystem(conf)
        done = self.version()
        versions = {int(n[1:]): s.getPath() for s in files.listStatus(at) if (n := s.getPath().getName())[:1] == "v" and n[1:].isdigit()}
        kept = sorted(v for v in versions if v <= done)[-KEPT:]
        named = set()
        for v in kept:
            tables = json.loads(self.spark.read.text(f"{self.path}/v{v}/control").first()[0])["tables"]
            named |= {files.makeQualified(hadoop.Path(p)).toString() for places in tables.values() for p in places}
        gone = []
        for v, folder in versions.items():
            inside = [s.getPath() for s in files.listStatus(folder)]
            out = [p for p in inside if files.makeQualified(p).toString() not in named and not (v in kept and p.getName() == "control")]
            for p in [folder] if len(out) == len(inside) else out:
                files.delete(p, True)
                gone.append(p.toString())
        return gone

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Runs ``stream`` through ``apply``; with ``once`` it ends when what is there has been read."""
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files with source_id, source_index and tokens, so many per micro-batch."""
    schema = "source_index long, source_id string, tokens array<string>"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).select(F.col("source_index"), "source_id", "tokens")
