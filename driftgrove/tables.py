"""Tables in the shared folder, and numbering without a one-partition window."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share. Where it is unset a local master (tests) gets a folder of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='driftgrove-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes in an Arrow batch; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session keep to BATCH_ROWS and BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Folders of this process's tables.
_written: list[str] = []


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that ``materialise`` has written so far; results that still read them are lost."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = hadoop.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: The tables that a grown one is made of.
_parts: weakref.WeakKeyDictionary[DataFrame, list[DataFrame]] = weakref.WeakKeyDictionary()
#: Parts of a grown table, beyond which they become one.
MOST_PARTS = 16


def parts_of(df: DataFrame) -> list[DataFrame]:
    return _parts.get(df, [df])


def union_of(parts: list[DataFrame]) -> DataFrame:
    """The rows of all ``parts`` as one table that remembers them."""
    if len(parts) == 1:
        return parts[0]
    out = functools.reduce(DataFrame.unionByName, parts)
    _parts[out] = parts
    return out


def grown(base: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """``base`` and the rows of ``more``, of which alone a table is written, until there are MOST_PARTS and all are written as one."""
    parts = [*parts_of(base), materialise(more.select(base.columns), name)]
    return union_of(parts) if len(parts) <= MOST_PARTS else materialise(union_of(parts), name)


def materialise_all(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """``materialise`` for tables that don't depend on each other, side by side: a small one costs the driver's time more than the executors'."""
    with ThreadPoolExecutor(min(8, max(1, len(tables)))) as pool:
        return list(pool.map(lambda x: materialise(x[1], x[0]), tables.items()))


#: Whether a query deletes its shuffle files once it has ended; else they stay until the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, what is written leaves no shuffle files behind."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def write_in_order(pieces: DataFrame, order: list[str], path: str) -> None:
    """One text file at ``path``, a line for each ``text`` of ``pieces`` in order: executors write its parts, the driver copies them together without holding them.

    Parts are compressed, each goes once it is copied, and what was exchanged for them goes before, so that no more than the text itself is on disk at any time, or nearly.
    """
    spark = pieces.sparkSession
    folder = f"{shared_dir(spark)}/pieces-{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        pieces.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.option("compression", "gzip").text(folder)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(folder), hadoop.fs.Path(path)
    files = source.getFileSystem(conf)
    codecs = hadoop.io.compress.CompressionCodecFactory(conf)
    parts = sorted(s.getPath().toString() for s in files.listStatus(source) if s.getPath().getName().startswith("part-"))
    out = target.getFileSystem(conf).create(target, True)
    try:
        for p in parts:
            part = hadoop.fs.Path(p)
            data = codecs.getCodec(part).createInputStream(files.open(part))
            try:
                hadoop.io.IOUtils.copyBytes(data, out, 1 << 20, False)
            finally:
                data.close()
            files.delete(part, False)
    finally:
        out.close()
    files.delete(source, True)


def numbered(df: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """``df`` with ``name``: its place in the given order, from ``start``.

    Two levels: rows are range-partitioned and sorted, each partition's rows are counted, and the sums
    of the counts before it (a row per partition, broadcast) give the first number of each.
    """
    split = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    held = materialise(split, "numbered")
    counts = held.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + start).alias("__first"))  # a row per partition
    placed = held.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(first), "__part")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
