"""The corpus pipeline: each stage works on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. The caller writes each result as Parquet and reads it again for the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrove.llm import bpe, exact_dedup, jaccard_tree, langid, mixing
from driftgrove.llm.common import materialise, table
from driftgrove.llm.queries import MIX, MIX_SEED, VOCABULARY

#: A text goes if less than this share of its n-grams belongs to its best language.
LEAST_SCORE = 0.2
#: Fitted, deduplicated and mixed texts depend on hashes and trained filters that SQL can't express.
ORACLE_SQL = None


def aside(docs: DataFrame, columns: list[str], operator: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    """``operator`` over ``columns`` alone, with all columns of ``docs`` packed into ``__own``, clear of the operator's own names."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own")
    return operator(docs.select(*columns, own), *args, **kwargs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those that look like none of the languages of ``lang``.

    Null and empty texts have no letters. Rows that repeat another go or stay together.
    """
    told = aside(docs, ["text"], langid.identify, langid.train(docs))
    return told.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*[F.col(f"__own.`{c}`") for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each content; null and empty texts are one content."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of the n-gram Jaccard join: that with the smallest id, null last, then by a hash.

    Rows are told apart by a 128-bit digest of id and text, so rows that share an id, or have none, go or stay each
    on its own. Rows equal in both are one here; exact dedup leaves no such rows.
    """
    own_id = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    own_text = F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit(""))
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.concat_ws(":", F.char_length(own_id).cast("string"), own_id, own_text).cast("binary"))))
    found = jaccard_tree.link_components(keyed.select("__key", "text"), key="__key").filter("n_shingles > 0").select("__key", "component_id")
    found = materialise(found, "pipeline-linked")
    several = found.filter("__key <> component_id").select("component_id").distinct()
    members = found.join(several, "component_id", "left_semi").distinct()
    members = materialise(keyed.select("__key", "doc_id").join(members, "__key").distinct(), "pipeline-members")
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__key"))["__key"].alias("__key"))
    dropped = materialise(members.select("__key").join(kept.select("__key"), "__key", "left_anti"), "pipeline-near")
    if dropped.count() <= jaccard_tree.MAX_BROADCAST:
        dropped = F.broadcast(dropped)
    return keyed.join(dropped, "__key", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents at random so that the sources have their target shares, in random order.

    A null source is one of the others. Rows that repeat an id get the same number of copies.
    """
    return aside(docs, ["doc_id", "source"], mixing.mix, MIX, seed=MIX_SEED).select(*[F.col(f"__own.`{c}`") for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether the ids decode to the text; a null text is encoded as the empty one."""
    rows = bpe.encode(docs.withColumn("__bytes", F.coalesce("text", F.lit("")).cast("binary")), VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "__bytes"], decoded=True)
    return rows.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.col("__bytes")).alias("decodes"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("jaccard_join", near_duplicates),
    ("source_mix", mixed),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
