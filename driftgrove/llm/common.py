"""Helpers shared by the operators of this subpackage.

Column names that begin with two underscores are the operators' own; input columns of that kind may be lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrove.tables import drop_written, materialise, shared_dir, small_batches

__all__ = ["crc_remainder", "drop_written", "hash_share", "id_text", "map_text", "materialise", "shared_dir", "small_batches", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(col: Column) -> Column:
    """An id as text; null becomes the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def crc_remainder(col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(id_text(col).cast("binary")) % F.lit(modulus)


def hash_share(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def map_text(
    df: DataFrame,
    fn: Callable[[pa.Array], list[pa.Array]],
    fields: list[T.StructField],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (default: all columns) plus what ``fn`` makes of each Arrow batch of texts.

    A kept column with the name of a new one gives way to the new one.
    """
    new = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([src.schema[c] for c in keep] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(i) for i in range(len(names) - len(fields))]
                yield pa.RecordBatch.from_arrays(columns + fn(batch.column(batch.num_columns - 1)), names=names)

    small_batches(df.sparkSession)
    return src.mapInArrow(run, schema)


def utf8(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null becomes the empty text."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
