"""Reading sources (documents as bags of tokens) from JSON, CSV and tables, and writing batches."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrove.functions import text as tx
from driftgrove.tables import materialise, numbered, small_batches, write_in_order

SOURCE = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("batch_index", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("timestamp_unix_ms", T.LongType()),
        T.StructField("metadata", T.StringType()),
    ]
)
BATCH = T.StructType([T.StructField("batch_index", T.LongType()), T.StructField("sources", T.ArrayType(SOURCE))])
#: Columns of the CSV layout that become metadata, with their keys.
CSV_METADATA = ("Timestamp", "API_Timestamp", "URL", "Query", "NewsCategory", "AlertFlag", "Relevance")
CSV_TEXT = ("Title", "ShortSummary", "Description")


#: A line is a batch with its sources, or one source.
EITHER = T.StructType([*SOURCE.fields, T.StructField("sources", T.ArrayType(SOURCE))])


def _by_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line that isn't blank is a whole JSON object."""
    first = spark.read.text(path).select(F.trim("value").alias("v")).filter(F.length("v") > 0).first()
    return first is not None and first["v"].startswith("{") and first["v"].endswith("}")


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Sources from JSON in any of its shapes: one document or lines, batches with their sources or bare sources.

    source_index is the place within a batch, and for bare sources, whose file has no order across
    tasks, their place in order of source_id. Lines that are neither are passed over.
    """
    raw = spark.read.schema(EITHER).option("multiLine", not _by_lines(spark, path)).json(path)
    wrapped = raw.filter("sources IS NOT NULL").select("batch_index", F.posexplode("sources").alias("source_index", "s"))
    inner = [F.col(f"s.{c}").alias(c) for c in SOURCE.names if c != "batch_index"]
    wrapped = wrapped.select("batch_index", F.col("source_index").cast("long").alias("source_index"), *inner)
    bare = numbered(raw.filter("sources IS NULL AND source_id IS NOT NULL").drop("sources"), ["source_id"], "source_index", 0)
    return wrapped.unionByName(bare.select(*wrapped.columns))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """The sources of one large JSON document, {batch_index, sources} or an array of sources, read by as many tasks as its size asks for.

    The text is read in pieces that end with ``}``, which Spark splits by byte ranges. A first reading tells of each
    range what it does to a string and to the depth, whether it begins in a string or not; sums over the ranges then
    tell where each begins. A source within a range is put together by the task that reads it. Only those at the ends of
    ranges are exchanged, and no text but theirs is written; no row holds more than a source.
    source_index is the place in a batch, and for a bare array the order of source_id, as in ``read_batch``.
    """
    small_batches(spark)
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):  # else the ranges change with the number of executors
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = spark.read.option("lineSep", "}").text(path)
    pieces = lines.select(meta("file_path").alias("file"), meta("file_block_start").alias("block"), F.concat("value", F.lit("}")).alias("text"))
    ranges = pieces.mapInArrow(_told_ranges, RANGE).collect()  # two rows per byte range
    starts = _starts(ranges)
    edge = "file string, block long, at long, array boolean, place long, ended int, text string"
    edges = materialise(pieces.mapInArrow(functools.partial(_edges, starts), edge), "json-edges")
    whole = edges.groupBy("file", "array", "place").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("parts"), F.max("ended").alias("ended"))
    whole = whole.select("file", "array", "place", "ended", F.array_join("parts.text", "").alias("text"))
    # what is before the first source and after the last one belongs to the document
    frame = F.when(F.col("ended") == 0, F.col("text")).otherwise(F.regexp_extract("text", r'(?s)^(.*?"sources"\s*:\s*\[)', 1))
    found = F.regexp_extract(frame, r'"batch_index"\s*:\s*(-?[0-9]+)', 1)
    batch = whole.filter("NOT array AND (place = 0 OR ended = 0)").groupBy("file").agg(F.max(F.nullif(found, F.lit(""))).cast("long").alias("batch_index"))
    own = F.when((F.col("place") == 0) & ~F.col("array"), F.regexp_replace("text", r'(?s)^.*?"sources"\s*:\s*\[', "")).otherwise(F.col("text"))
    rows = whole.filter("ended = 1").select("file", "array", "place", own.alias("text"))
    rows = rows.unionByName(pieces.mapInArrow(functools.partial(_inner, starts), "file string, array boolean, place long, text string"))
    parsed = F.from_json(F.regexp_replace("text", r"^[\s,\[]+", ""), SOURCE)
    rows = rows.select("file", "array", F.col("place").alias("source_index"), parsed.alias("s"))
    inner = [F.col(f"s.{c}").alias(c) for c in SOURCE.names if c != "batch_index"]
    wrapped = rows.filter("NOT array").join(F.broadcast(batch), "file", "left").select("batch_index", "source_index", *inner)  # a row per file
    if not any(array for array, *_ in starts.values()):
        return wrapped
    bare_rows = rows.filter("array").select("s.*").filter("source_id IS NOT NULL")
    return wrapped.unionByName(numbered(bare_rows, ["source_id"], "source_index", 0).select(*wrapped.columns))


#: What a byte range does if it begins ``inside`` a string or not: ``odd`` quotes, ``step`` deeper; ``ends``: pieces that end outside strings, by depth.
RANGE = "file string, block long, inside int, odd int, step long, head string, ends array<struct<depth:long,n:long,first:long,last:long>>"


def _steps(text: str) -> tuple[int, int, int]:
    """(whether the quotes are odd, depth gained if the text begins outside a string, and inside one)."""
    parts = re.sub(r"\\.", "", text).split('"') if "\\" in text else text.split('"')
    deeper = lambda s: s.count("{") + s.count("[") - s.count("}") - s.count("]")
    return (len(parts) - 1) % 2, deeper("".join(parts[::2])), deeper("".join(parts[1::2]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, str] | None]:
    """((file, block), number within it, text) of a task's pieces in order; None after each batch."""
    key, at = None, 0
    for b in batches:
        for *own, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            own = tuple(own)
            key, at = own, (at + 1 if own == key else 0)
            yield key, at, text
        yield None


def _told_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "block", "inside", "odd", "step", "head", "ends"]
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("depth", "n", "first", "last")]))
    key, head, odd, depth, ends = None, "", 0, [0, 0], [{}, {}]

    def row() -> Iterator[pa.RecordBatch]:
        if key is not None:
            told = [[{"depth": d, "n": n, "first": first, "last": last} for d, (n, first, last) in x.items()] for x in ends]
            columns = [[key[0]] * 2, [key[1]] * 2, [0, 1], [odd] * 2, depth, [head] * 2, told]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for piece in _pieces(batches):
        if piece is None:
            continue
        own, at, text = piece
        if own != key:
            yield from row()
            key, head, odd, depth, ends = own, text[:1000].lstrip(), 0, [0, 0], [{}, {}]
        turns, *steps = _steps(text)
        for inside in (0, 1):
            depth[inside] += steps[inside ^ odd]
        odd ^= turns
        # outside now is what began outside with even quotes, or inside with odd ones
        n, first, _ = ends[odd].get(depth[odd], (0, at, at))
        ends[odd][depth[odd]] = (n + 1, first, at)
    yield from row()


def _starts(ranges: list[Row]) -> dict[tuple[str, int], tuple[bool, int, int, int, int]]:
    """By byte range: (whether its file is an array, the place of the source that it begins in, how many sources end in it, the first piece that ends one, the last)."""
    files: dict[str, dict[int, dict[int, Row]]] = {}
    for r in ranges:
        files.setdefault(r["file"], {}).setdefault(r["block"], {})[r["inside"]] = r
    out = {}
    for file, blocks in files.items():
        array = blocks[min(blocks)][0]["head"].startswith("[")
        inside = depth = place = 0
        for block in sorted(blocks):
            r = blocks[block][inside]
            n, first, last = next(((x["n"], x["first"], x["last"]) for x in r["ends"] if x["depth"] == (1 if array else 2) - depth), (0, -1, -1))
            out[file, block] = (array, place, n, first, last)
            inside, depth, place = inside ^ r["odd"], depth + r["step"], place + n
    return out


def _edges(starts: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of sources that a byte range may have only a part of, and of what is no source."""
    rows: list[tuple] = []
    for piece in _pieces(batches):
        if piece is None:
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "at", "array", "place", "ended", "text"])
            rows = []
            continue
        key, at, text = piece
        array, place, n, first, last = starts[key]
        if not n or at <= first:
            rows.append((*key, at, array, place, int(n > 0 and at == first), text))
        elif at > last:
            rows.append((*key, at, array, place + n, 0, text))


def _inner(starts: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sources that are whole within a byte range, but its first."""
    rows: list[tuple] = []
    parts, depth, odd, done = [], 0, 0, 0
    for piece in _pieces(batches):
        if piece is None:
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), pa.bool_(), pa.int64(), pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "array", "place", "text"])
            rows = []
            continue
        key, at, text = piece
        array, place, n, first, last = starts[key]
        if not n or at > last or at < first:
            continue
        if at == first:
            parts, depth, odd, done = [], 0, 0, 1
            continue
        turns, *steps = _steps(text)
        depth, odd = depth + steps[odd], odd ^ turns
        parts.append(text)
        if not odd and not depth:
            rows.append((key[0], array, place + done, "".join(parts)))
            parts, done = [], done + 1


def write_batch_document(sources: DataFrame, path: str) -> None:
    """One JSON document {batch_index, sources} of a batch of any size, put together from parts."""
    own = sources.select(F.lit(1).alias("section"), "source_index", F.to_json(F.struct("source_id", "batch_index", "tokens", "text", "timestamp_unix_ms", "metadata")).alias("json"))
    first = sources.agg(F.min("source_index").alias("first"), F.any_value("batch_index").alias("batch")).first()
    lines = own.select("section", "source_index", F.concat(F.when(F.col("source_index") == F.lit(first["first"]), "").otherwise(","), "json").alias("text"))
    frame = [(0, 0, f'{{"batch_index":{first["batch"] or 0},"sources":['), (2, 0, "]}")]
    frame = sources.sparkSession.createDataFrame(frame, "section int, source_index long, text string")
    write_in_order(frame.unionByName(lines), ["section", "source_index"], path)


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """A table or batch by the extension of its path: CSV as text columns, JSON as sources; others are refused."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("json", "jsonl"):
        return read_batch(spark, path)
    raise ValueError(f"neither CSV nor JSON: {path}")


def write_lines(sources: DataFrame, path: str) -> None:
    """A JSON line for each source, written by the executors; ``read_batch`` reads them back."""
    sources.select(*SOURCE.names).write.mode("overwrite").json(path)


def read_json_batch(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document {batch_index, sources}, or JSON lines of such: a row per source, source_index being its place."""
    whole = spark.read.schema(BATCH).option("multiLine", True).json(path)
    return whole.select("batch_index", F.posexplode("sources").alias("source_index", "s")).select(
        "batch_index", F.col("source_index").cast("long").alias("source_index"), "s.source_id", "s.tokens", "s.text", "s.timestamp_unix_ms", "s.metadata"
    )


def read_json_sources(spark: SparkSession, path: str) -> DataFrame:
    """Bare sources, as a JSON array or as lines; source_index follows the order of source_id."""
    raw = spark.read.schema(SOURCE).option("multiLine", not _by_lines(spark, path)).json(path)
    return numbered(raw.filter("source_id IS NOT NULL"), ["source_id"], "source_index", 0)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header; every column is text, rows may be short."""
    return spark.read.csv(path, header=True, mode="PERMISSIVE", multiLine=True, quote='"', escape='"')


def csv_rows(table: DataFrame) -> DataFrame:
    """A CSV table with ``__row``, the number of each row from 1, across files by name."""
    marked = table.withColumn("__file", F.col("_metadata.file_path")).withColumn("__at", F.monotonically_increasing_id())
    return numbered(marked, ["__file", "__at"], "__row").drop("__file", "__at")


def csv_sources(table: DataFrame, row_number: Column | str, batch_index: int = 0, min_tokens: int = 1, stop_words: tuple[str, ...] = tx.STOP_WORDS) -> DataFrame:
    """Sources from rows with title, summary and description.

    ``row_number`` counts all rows from 1 and names the source; rows without text or with fewer
    than ``min_tokens`` tokens after stop words are left out. Missing columns count as empty.
    """
    number = F.col(row_number) if isinstance(row_number, str) else row_number
    cell = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in table.columns else F.lit("")
    body = tx.squeeze(F.concat_ws(" ", *[cell(c) for c in CSV_TEXT]))
    filled = F.array_compact(F.array(*[F.when(F.length(tx.trim(cell(c))) > 0, F.struct(F.lit(c.lower()).alias("key"), tx.trim(cell(c)).alias("value"))) for c in CSV_METADATA]))
    rows = table.select(number.cast("long").alias("source_index"), body.alias("text"), F.to_json(F.map_from_entries(filled)).alias("metadata"))
    tokens = tx.words(F.col("text"), stop_words)
    out = rows.filter(F.length("text") > 0).withColumn("tokens", tokens).filter(F.size("tokens") >= min_tokens)
    return out.select(
        F.lit(batch_index).cast("long").alias("batch_index"), "source_index", F.format_string("row_%06d", F.col("source_index")).alias("source_id"), "tokens", "text",
        F.lit(None).cast("long").alias("timestamp_unix_ms"), "metadata",
    )


def from_documents(docs: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """The ``documents`` table as sources of batch 0, in order of doc_id."""
    return docs.select(
        F.lit(0).cast("long").alias("batch_index"), F.col("doc_id").alias("source_index"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("source_id"),
        tx.words(F.col("text"), stop_words).alias("tokens"), "text", F.lit(None).cast("long").alias("timestamp_unix_ms"),
        F.to_json(F.struct("lang", "source")).alias("metadata"),
    )


def from_pages(pages: DataFrame) -> DataFrame:
    """The ``pages`` table as sources of batch 0, in order of page_id: the tokens of a page are the words of its url."""
    return pages.select(
        F.lit(0).cast("long").alias("batch_index"), F.col("page_id").alias("source_index"), F.concat(F.lit("page_"), F.col("page_id")).alias("source_id"),
        tx.words(F.col("url")).alias("tokens"), F.col("url").alias("text"), F.lit(None).cast("long").alias("timestamp_unix_ms"), F.to_json(F.struct("url")).alias("metadata"),
    )


def chunked(sources: DataFrame, chunks: int = 8) -> DataFrame:
    """Deals the sources out to ``chunks`` batches by order, the first ones a source larger where it doesn't divide."""
    if chunks < 1:
        raise ValueError("at least one chunk")
    placed = numbered(sources.select("source_index"), ["source_index"], "__n", 0)
    n = placed.count()
    size, more = divmod(n, chunks)
    starts = [k * size + min(k, more) for k in range(1, chunks)]
    # the sources about each cut: where an index changes there, it tells the batches apart, and no source needs to move
    near = {r["__n"]: r["source_index"] for r in placed.filter(F.col("__n").isin([x for k in starts for x in (k - 1, k)])).collect()} if n else {}
    cuts = [(near[k - 1], near[k]) for k in starts if k < n]
    if all(a < b for a, b in cuts):
        over = [F.when(F.col("source_index") >= F.lit(b), 1).otherwise(0) for _, b in cuts]
        return sources.withColumn("batch_index", functools.reduce(lambda x, y: x + y, over, F.lit(0)).cast("long"))
    placed = numbered(sources.drop("batch_index"), ["source_index"], "__n", 0)
    at = F.col("__n")
    rest = F.floor((at - F.lit(more)) / F.lit(max(size, 1)))
    index = F.when(at < more * (size + 1), F.floor(at / F.lit(size + 1))).otherwise(rest)
    return placed.withColumn("batch_index", index.cast("long")).drop("__n")


def chunks_of_size(total: int, size: int) -> int:
    """How many chunks of at most ``size`` sources there are."""
    if size < 1:
        raise ValueError("chunk size must be positive")
    return max(1, -(-total // size))


def catalog(sources: DataFrame) -> DataFrame:
    """source_id, title, url: the first 120 characters of the text, else the first 16 tokens, else the id; the url from metadata."""
    head = F.nullif(F.substring(tx.trim(F.coalesce("text", F.lit(""))), 1, 120), F.lit(""))
    some = F.nullif(F.array_join(F.slice(F.coalesce("tokens", F.array().cast("array<string>")), 1, 16), " "), F.lit(""))
    url = F.coalesce(F.get_json_object("metadata", "$.url"), F.get_json_object("metadata", "$.URL"), F.lit(""))
    return sources.select("source_id", F.coalesce(head, some, "source_id").alias("title"), url.alias("url"))


def batch_json(sources: DataFrame) -> DataFrame:
    """One JSON document per batch_index: {batch_index, sources in order}."""
    one = F.struct("source_index", F.struct("source_id", "batch_index", "tokens", "text", "timestamp_unix_ms", "metadata").alias("s"))
    rows = sources.groupBy("batch_index").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("sources"))
    return rows.select("batch_index", F.to_json(F.struct("batch_index", "sources")).alias("json"))


def write_batch_json(sources: DataFrame, path: str) -> None:
    """One pretty JSON file of a batch, on the driver: for small batches and exchange with other tools."""
    rows = batch_json(sources).collect()
    if len(rows) != 1:
        raise ValueError(f"one batch is wanted, there are {len(rows)}")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump(json.loads(rows[0]["json"]), f, indent=2, ensure_ascii=False)


def write_partitions(sources: DataFrame, path: str) -> None:
    """Parquet, a folder per batch_index, so that a window of batches is read by partition pruning."""
    sources.write.mode("overwrite").partitionBy("batch_index").parquet(path)


def read_window(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The batches from ``first`` to ``last`` of what ``write_partitions`` wrote."""
    return spark.read.parquet(path).filter(F.col("batch_index").between(first, last))
