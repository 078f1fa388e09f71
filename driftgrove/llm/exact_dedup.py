"""Exact deduplication by skew-safe combining.

Rows are combined three times, and each time by digest *and* full normalised content: within
the task that read them (the map side of the first aggregation), within salted digest groups,
and over the winners of the salts. A group that holds a third of all rows therefore reaches any
task as one row per earlier task at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrove.llm.common import materialise

#: White space that doesn't count.
BLANK = "[\\x20\\x09-\\x0D]+"
#: Salts of a digest group.
SALTS = 64


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def content_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per distinct content: digest, content, best (of its rows), group_size."""
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("n"),
        normalise(F.col("text")).alias("content"),
        F.xxhash64("text").alias("tie"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    ).withColumn("digest", digest(F.col("content")))
    first = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("tie").alias("tie"))
    salted = rows.groupBy("digest", "content", "salt").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("size"))
    return salted.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("size").alias("group_size"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """Every row of ``docs`` with its group: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space; null counts as empty. The
    row with the most code points stays, then the one with the smallest doc_id, a null doc_id
    last; of rows with the same doc_id and as many code points the text with the smallest hash.
    Rows that repeat both doc_id and text are one document and share ``kept``. An empty table
    gives an empty result. Columns other than doc_id and text are not read.

    The groups are joined back by digest alone; should two contents share a digest, they are
    joined back by digest and content. A group that holds a large part of all rows is one key of
    that join, which adaptive execution splits (spark.sql.adaptive.skewJoin.enabled, the default).
    """
    groups = content_groups(docs, digest, salts)
    keys = ["digest"]
    narrow = materialise(groups.select("digest", "best", "group_size"), "exact")
    if narrow.groupBy("digest").count().filter("count > 1").limit(1).count():
        keys = ["digest", "content"]
        narrow = groups.select("digest", "content", "best", "group_size")
    rows = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), F.xxhash64("text").alias("tie"), normalise(F.col("text")).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content"))).withColumn("text_sha256", sha256(F.col("content")))
    if keys == ["digest"]:
        rows = rows.drop("content")
    kept = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n") == -F.col("best.n")) & (F.col("tie") == F.col("best.tie"))
    return rows.join(narrow, keys, "left").select("doc_id", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each content, with all their columns.

    The row is the one that ``deduplicate`` keeps; rows that repeat its doc_id and text are reduced
    to one, a null doc_id counting as a value. An empty table gives an empty result.

    The hashed side of the join has about 100 bytes for each content, spread evenly by digest and
    id, so it takes a fixed small part of the texts that the same task reads.
    """
    groups = content_groups(docs).select("digest", "best")
    kept = materialise(groups, "exact-kept").select(F.col("digest").alias("__keep"), F.col("best.id").alias("__keep_id"), F.col("best.tie").alias("__keep_tie"))
    marked = docs.withColumn("__digest", sha256(normalise(F.col("text")))).withColumn("__tie", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__keep_id")) & (F.col("__digest") == F.col("__keep")) & (F.col("__tie") == F.col("__keep_tie"))
    return marked.join(kept.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["doc_id", "__digest"]).drop("__digest", "__tie")
