"""Ranked lexical search: document-at-a-time over compressed postings, shard by shard.

Each task cuts its documents into shards of bounded text. Within a shard the documents are numbered
by ascending doc_id; a term's postings are the gaps between their numbers and the term frequencies,
both as variable-length bytes. A query merges the postings of its terms by a heap on the document
number, so that a document is scored in whole when it comes up, and keeps the best k in a bounded
heap by score, then doc_id. The heaps of all tasks are merged at the end.

Terms whose best contributions together can't reach the worst score of a full heap open no
document any more; they are looked up for the documents that other terms bring. Nothing is lost by it.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgrove.llm.common import materialise, small_batches
from driftgrove.llm.url_rules import LOWER, UPPER

#: What lies between terms: ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: UTF-8 bytes of a shard's texts (a longer text is a shard of its own), and its most documents.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 17
#: Items that are searched at once, and their most terms with repeats; both are sent to all tasks.
BLOCK_ITEMS, BLOCK_TERMS = 2000, 200_000
INDEX = "shard long, term string, df long, total long, postings binary, ids array<long>, lengths array<long>"
HITS = "item int, doc_id long, score long"


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, where each one ends): seven bits a byte, the low ones first, the last byte below 128."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        if not len(v) or not (more := v >= np.uint64(1 << bits)).any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[ends[has] - size[has] + k] = (v[has] >> np.uint64(7 * k) & np.uint64(127)) | np.where(size[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, ends


def values_of(data: bytes) -> np.ndarray:
    """The values of ``varints``."""
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    if len(last) == len(b):
        return b.astype(np.int64)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts in order, how many each text has)."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
    sizes = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten()
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(sizes)), sizes)
    return flat.filter(pa.array(there)), np.bincount(text[there], minlength=len(sizes))


def shard_rows(shard: int, ids: pa.Array, terms: pa.Array, lengths: np.ndarray) -> pa.RecordBatch:
    """The index of a shard: a row for each term, and one with the empty term for its documents."""
    there = lengths > 0
    ids, lengths = ids.filter(pa.array(there)), lengths[there]
    unnamed = ids.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), unnamed))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    coded = terms.dictionary_encode()
    n = max(len(order), 1)
    key = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(number, lengths)
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // n, key % n
    df = np.bincount(term, minlength=len(coded.dictionary))
    start = np.cumsum(df) - df
    gap = np.diff(doc, prepend=0)
    gap[start] = doc[start]
    both = np.empty(2 * len(doc), np.int64)  # of each term, its gaps and then its frequencies
    at = np.arange(len(doc)) + np.repeat(start, df)
    both[at], both[at + np.repeat(df, df)] = gap, tf
    data, ends = varints(both)
    offsets = np.concatenate(([0], ends[2 * (start + df) - 1] if len(df) else [])).astype(np.int32)
    postings = pa.BinaryArray.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    t = len(df)
    lists = lambda values: pa.array([None] * t + [values], pa.list_(pa.int64()))
    columns = [
        pa.array(np.full(t + 1, shard)),
        pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""])]),
        pa.array(np.append(df, len(order))),
        pa.array(np.append(np.zeros(t, np.int64), lengths.sum())),
        pa.concat_arrays([postings, pa.array([None], pa.binary())]),
        lists(ids.take(pa.array(order)).to_pylist()),
        lists(lengths[order].tolist()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "df", "total", "postings", "ids", "lengths"])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all rows as a table, in shards; ids are integers.

    A null text has no terms, as an empty one; documents without terms aren't in the index. Rows that
    repeat an id are documents of their own, and a null id comes after all others. An empty table
    gives an empty index. A task holds one shard at a time, or one text where that is longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0
        ids, terms, lengths, size = [], [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            found, n = terms_of(b.column(1))
            ids.append(b.column(0))
            terms.append(found)
            lengths.append(n)
            size += b.column(1).nbytes
            if size >= SHARD_BYTES or sum(map(len, ids)) >= SHARD_DOCS:
                yield shard_rows(part + made, pa.concat_arrays(ids), pa.concat_arrays(terms), np.concatenate(lengths))
                made += 1
                ids, terms, lengths, size = [], [], [], 0
        if ids:
            yield shard_rows(part + made, pa.concat_arrays(ids), pa.concat_arrays(terms), np.concatenate(lengths))

    small_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return materialise(src.mapInArrow(run, INDEX).filter("df > 0"), "lexical-index")


def query_terms(text: Column) -> Column:
    """The distinct terms of a text."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.array_distinct(F.split(lower, BETWEEN)), "")


class Shard:
    """Postings of the terms in question among a shard's documents, as contributions to a score."""

    def __init__(self, ids: list[int | None], lengths: list[int], n_docs: int, n_terms: int):
        self.ids, self.lists = ids, {}
        self.m = np.array([10 + 90 * n * n_docs // n_terms for n in lengths], np.int64)

    def add(self, term: str, weight: int, postings: bytes) -> None:
        both = values_of(postings)
        docs, tf = np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]
        gains = weight * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[docs]))
        self.lists[term] = (int(gains.max()), docs.tolist(), gains.tolist())

    def search(self, terms: list[str], k: int, best: list[tuple]) -> None:
        """Updates ``best``, a heap of at most k (score, whether it has an id, -id), by this shard's documents."""
        lists = sorted((self.lists[t] for t in terms if t in self.lists), key=lambda x: x[0])
        reach = [0]
        for most, _, _ in lists:
            reach.append(reach[-1] + most)
        floor = best[0][0] if len(best) == k else 1
        opens = 0  # lists before this one no longer open a document
        while opens < len(lists) and reach[opens + 1] < floor:
            opens += 1
        cursors = [(lists[j][1][0], j, 0) for j in range(opens, len(lists))]
        heapq.heapify(cursors)
        while cursors:
            doc, score = cursors[0][0], 0
            while cursors and cursors[0][0] == doc:
                _, j, at = cursors[0]
                docs = lists[j][1]
                if j < opens:
                    heapq.heappop(cursors)
                    continue
                score += lists[j][2][at]
                if at + 1 < len(docs):
                    heapq.heapreplace(cursors, (docs[at + 1], j, at + 1))
                else:
                    heapq.heappop(cursors)
            for j in range(opens - 1, -1, -1):
                if score + reach[j + 1] < floor:
                    break
                docs = lists[j][1]
                at = bisect_left(docs, doc)
                if at < len(docs) and docs[at] == doc:
                    score += lists[j][2][at]
            if score < floor:
                continue
            own = self.ids[doc]
            entry = (score, own is not None, -(own or 0))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
            if len(best) == k and best[0][0] > floor:
                floor = best[0][0]
                while opens < len(lists) and reach[opens + 1] < floor:
                    opens += 1


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search_block(index: DataFrame, items: list[tuple[int, list[str]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each (number, terms), from each task."""
    spark: SparkSession = index.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for _, terms in items for t in terms})], "term string"))
    counts = index.select("term", "df").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weights = {r["term"]: w for r in counts.collect() if (w := weight(n_docs, r["df"])) > 0}
    rows = index.join(wanted, "term", "left_semi").select("shard", "term", "postings", "ids", "lengths")
    rows = rows.unionByName(index.filter("term = ''").select("shard", "term", "postings", "ids", "lengths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        shard = None

        def finish() -> None:
            if shard and shard.lists:
                for (_, terms), heap in zip(items, best, strict=True):
                    shard.search(terms, k, heap)

        for b in batches:
            term, postings, ids, lengths = (b.column(i) for i in (1, 2, 3, 4))
            for i, t in enumerate(term.to_pylist()):
                if t == "":  # comes first in its shard
                    finish()
                    shard = Shard(ids[i].as_py(), lengths[i].as_py(), n_docs, n_terms)
                elif t in weights:
                    shard.add(t, weights[t], postings[i].as_py())
        finish()
        out = [(i, -x if named else None, score) for (i, _), heap in zip(items, best, strict=True) for score, named, x in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    small_batches(spark)
    return rows.repartition("shard").sortWithinPartitions("shard", "term").mapInArrow(run, HITS)


def search(index: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, rank, doc_id, score: the k best documents of each row of ``items`` with a score above 0.

    Equal scores go by ascending doc_id, null last. A null or empty text, or one without a term of the
    index, has no hits. Rows of ``items`` that repeat an id are each searched and ranked on their
    own. Items go through in blocks, each read from the index once for the document frequencies of
    its terms and once for their postings.
    """
    spark = index.sparkSession
    sums = index.filter("term = ''").agg(F.sum("df").alias("docs"), F.sum("total").alias("terms")).first()
    found: DataFrame | None = None
    named = items.select(F.col(f"`{key}`").alias("key"), query_terms(F.col(f"`{text}`")).alias("terms"))
    key_type = named.schema["key"].dataType.simpleString()

    def searched(block: list) -> DataFrame:
        hits = search_block(index, [(i, r["terms"]) for i, r in enumerate(block)], sums["docs"], sums["terms"], k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        keys = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(block)], f"item int, key {key_type}")
        return materialise(best.join(F.broadcast(keys), "item").select(F.col("key").alias(key), "rank", "doc_id", "score"), "lexical-hits")

    block, size = [], 0
    for r in named.toLocalIterator() if sums["docs"] else ():
        if block and (len(block) >= BLOCK_ITEMS or size + len(r["terms"]) > BLOCK_TERMS):
            hits = searched(block)
            found = found.unionByName(hits) if found else hits
            block, size = [], 0
        block.append(r)
        size += len(r["terms"])
    if block:
        hits = searched(block)
        found = found.unionByName(hits) if found else hits
    return found if found is not None else spark.createDataFrame([], f"`{key}` {key_type}, rank int, doc_id long, score long")
