"""What the queries work on.

Queries on words and on drift take ``documents`` as sources, in eight batches, and a tree of fixed
shape over their commonest words, whose every figure SQL can tell. Queries on built trees take the
words of the urls in ``pages``: some ten words to a source, as in headlines, so that a tree with
the usual minimum of 20 sources to a branch ends by itself.

Tables that several parts of a query share are made once for the query; ``query`` in ``queries``
forgets them before each.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgrove.config import BuilderConfig, Config, ThresholdConfig
from driftgrove.engine import Engine
from driftgrove.functions.text import STOP_WORDS
from driftgrove.operators import drift, postings
from driftgrove.operators.export import TreeExport
from driftgrove.tables import materialise, numbered
from driftgrove.sources import batches

BATCHES = 8
#: A node opens a branch if it has more sources.
MIN_SOURCES = 20
#: Sets of words of the fixed tree's nodes, by place in the ranking; the second tree hangs from node 1.
ROOT_WORDS, CHILD_WORDS = 8, 12


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.from_documents(documents(spark, sf_dir), STOP_WORDS)


_shared: list = []


def shared(f):
    """Makes what ``f`` returns once for a query."""
    held = functools.lru_cache(maxsize=4)(f)
    _shared.append(held)
    return held


def forget() -> None:
    for held in _shared:
        held.cache_clear()


@shared
def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(batches.chunked(sources(spark, sf_dir), BATCHES), "workload-dealt")


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches but the last, as one."""
    return _dealt(spark, sf_dir).filter(F.col("batch_index") < BATCHES - 1)


def last_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir).filter(F.col("batch_index") == BATCHES - 1)


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir)


@shared
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, first, nth, df of the baseline."""
    return materialise(postings.first_and_df(baseline(spark, sf_dir), clean=True), "workload-words")


@shared
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word_id, token, df of the baseline, numbered by first appearance."""
    made = numbered(words(spark, sf_dir), ["first", "nth"], "word_id")
    return materialise(made.select(F.col("word_id").cast("int").alias("word_id"), "token", "df"), "workload-vocabulary")


@shared
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, df, place, word_id of the first words in the baseline's ranking."""
    top = vocabulary(spark, sf_dir).orderBy(F.desc("df"), "word_id").limit(CHILD_WORDS)
    place = F.row_number().over(Window.orderBy(F.desc("df"), "word_id")).cast("long")  # CHILD_WORDS rows
    return materialise(top.select("token", "df", "word_id", place.alias("place")), "workload-ranks")


def known_tokens(rows: DataFrame) -> DataFrame:
    """source, token of sources, each token once."""
    return postings.doc_tokens(rows, clean=True).select(F.col("source_index").alias("source"), "token")


@shared
def fixed_state(spark: SparkSession, sf_dir: str) -> drift.State:
    """Four nodes of two words each and a refuge; under node 1 a tree of two more nodes."""
    top = ranks(spark, sf_dir)
    place = F.col("place")
    chosen = top.select("token", "word_id", place, F.when(place <= ROOT_WORDS, F.floor((place + 1) / 2)).otherwise(6 + F.floor((place - ROOT_WORDS - 1) / 2)).cast("int").alias("node_id"))
    # sources are cut into the chosen words alone, and once for all that follows
    line = F.broadcast(chosen.agg(F.collect_list("token").alias("__line")))  # CHILD_WORDS words in one row
    own = baseline(spark, sf_dir).crossJoin(line).select(F.col("source_index").alias("source"), F.explode(F.array_intersect("tokens", "__line")).alias("token"))
    held = materialise(own.join(F.broadcast(chosen), "token").select("node_id", "token", "source"), "workload-held")
    root = held.filter("node_id <= 4")
    first = root.filter("node_id = 1").select("source").distinct()
    pairs = materialise(root.unionByName(held.filter("node_id >= 6").join(first, "source", "left_semi").select("node_id", "token", "source")), "workload-pairs")
    lost = baseline(spark, sf_dir).select(F.col("source_index").alias("source")).join(pairs.filter("node_id <= 4").select("source"), "source", "left_anti")
    node_sources = pairs.select("node_id", "source").distinct().unionByName(lost.select(F.lit(5).alias("node_id"), "source"))
    nodes = spark.createDataFrame([(i, 1, i - 1, i == 5) for i in range(1, 6)] + [(6, 2, 0, False), (7, 2, 1, False)], "node_id int, hkt_id int, ord int, refuge boolean")
    expected = top.filter("place > 1").select(F.lit(1).alias("hkt_id"), "token").unionByName(top.filter(place > ROOT_WORDS + 1).select(F.lit(2).alias("hkt_id"), "token"))
    hkts = spark.createDataFrame([(1, 0), (2, 1)], "hkt_id int, parent_node_id int")
    return drift.State(hkts, nodes, chosen.select("node_id", "token", "word_id"), node_sources, pairs, expected).kept("workload")


def fixed_tree(spark: SparkSession, sf_dir: str) -> TreeExport:
    registry = baseline(spark, sf_dir).select("source_id", F.col("source_index").alias("source"))
    top = spark.createDataFrame([], "node_id int, token string, rank int")
    return TreeExport(fixed_state(spark, sf_dir), vocabulary(spark, sf_dir).select("word_id", "token"), top, registry)


def fixed_level(spark: SparkSession, sf_dir: str) -> drift.Level:
    """The last batch at the root of the fixed tree; the baseline counts as the first batch."""
    rows = last_batch(spark, sf_dir)
    first, seen = known_tokens(baseline(spark, sf_dir)), words(spark, sf_dir).select("token", "df")
    return drift.root_level(fixed_state(spark, sf_dir), rows.select(F.col("source_index").alias("source")), known_tokens(rows), first, ThresholdConfig(), seen.select("token"), seen)


def config(**more) -> Config:
    return Config(BuilderConfig(0.5, 0.5, MIN_SOURCES), **more)


def always(**more) -> Config:
    """Any batch triggers a rebuild."""
    names = [f"{n}_option{i}_threshold" for n, k in (("alpha", 3), ("beta", 3), ("word_importance", 2)) for i in range(1, k + 1)]
    return config(thresholds=ThresholdConfig(alpha=0.0, beta=0.0, **dict.fromkeys(names, 0.0)), **more)


def never(**more) -> Config:
    """No batch triggers one."""
    names = [f"{n}_option{i}_threshold" for n, k in (("alpha", 3), ("beta", 3), ("word_importance", 2)) for i in range(1, k + 1)]
    return config(thresholds=ThresholdConfig(alpha=0.0, beta=0.0, **dict.fromkeys(names, 1.0)), **more)


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@shared
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(batches.chunked(page_sources(spark, sf_dir), BATCHES), "workload-pages")


@shared
def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The tree of all batches of pages but the last."""
    e = Engine(spark, config())
    e.build_baseline(pages(spark, sf_dir).filter(F.col("batch_index") < BATCHES - 1))
    return e
