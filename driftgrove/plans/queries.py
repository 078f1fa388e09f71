"""Registry of the queries over the library's own operators."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from driftgrove.config import ThresholdConfig
from driftgrove.engine import Engine
from driftgrove.functions.text import STOP_WORDS
from driftgrove.operators import drift, export, postings, prune, views
from driftgrove.operators import tree as trees
from driftgrove.plans import workload as wl
from driftgrove.tables import materialise, numbered, shared_dir
from driftgrove.sources import batches, timeline
from driftgrove.streaming import registry

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Registers ``f``; each call makes the tables that its parts share anew."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        wl.forget()
        return f(spark, sf)

    REGISTRY[f.__name__] = run
    return f


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    from driftgrove.plans import oracle, plan_sql, tree_sql

    plan = plan_sql.plan(PLAN_LIMITS)
    asked = f"SELECT hkt_id, scoped_sources FROM ({plan}) WHERE triggered"
    return oracle.statements() | tree_sql.statements() | {"trigger_plan": plan, "rebuild_plan": asked}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all words by document frequency and first appearance."""
    return ranked_words(spark, sf_dir)


# -- sources


@query
def scan_sources(spark, sf):
    """The sources after a way through JSON lines."""
    path = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    batches.write_lines(wl.sources(spark, sf), path)
    rows = batches.read_batch(spark, path).drop("source_index").withColumn("source_index", F.split_part("source_id", F.lit("_"), F.lit(2)).cast("long"))
    return rows.select("batch_index", "source_index", "source_id", F.size("tokens").alias("n_tokens"), "metadata")


@query
def scan_document(spark, sf):
    """The sources after a way through one JSON document that several tasks read."""
    path = f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}.json"
    batches.write_batch_document(wl.sources(spark, sf), path)
    rows = batches.read_split(spark, path).drop("source_index").withColumn("source_index", F.split_part("source_id", F.lit("_"), F.lit(2)).cast("long"))
    return rows.select("batch_index", "source_index", "source_id", F.size("tokens").alias("n_tokens"), "metadata")


@query
def csv_ingest(spark, sf):
    docs = wl.documents(spark, sf)
    table = docs.select((F.col("doc_id") + 1).alias("row"), F.col("text").alias("Title"), F.col("lang").alias("ShortSummary"), F.col("source").alias("Description"), F.concat(F.lit(" http://x/"), "source", F.lit(" ")).alias("URL"))
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return batches.csv_sources(batches.read_csv(spark, path), F.col("row").cast("long"), 0, 3).select("source_index", "source_id", F.array_join("tokens", " ").alias("tokens"), "text", "metadata")


@query
def source_catalog(spark, sf):
    return batches.catalog(wl.sources(spark, sf))


@query
def source_ids(spark, sf):
    return postings.source_ids(wl.sources(spark, sf))


@query
def chunk_batches(spark, sf):
    return wl.dealt(spark, sf).groupBy("batch_index").agg(F.count(F.lit(1)).alias("sources"), F.min("source_index").alias("first"), F.max("source_index").alias("last"))


@query
def source_registry(spark, sf):
    """Each source with the last batch that it is in, by the engine; the last batch sends every tenth source again."""
    rows = wl.dealt(spark, sf)
    again = rows.filter(F.col("source_index") % 10 == 0).withColumn("batch_index", F.lit(wl.BATCHES).cast("long"))
    e = Engine(spark)
    for i, part in enumerate([rows.filter(F.col("batch_index") == i) for i in range(wl.BATCHES)] + [again]):
        e.register(part, i, clean=True)
    return e.source_batches()


@query
def stream_registry(spark, sf):
    """The sources in a window of three batches, by keyed streaming state; the last batch sends every tenth source again."""
    rows = wl.dealt(spark, sf).select("source_id", "source_index", F.col("batch_index").cast("long").alias("batch_index"))
    again = rows.filter(F.col("source_index") % 10 == 0).withColumn("batch_index", F.lit(wl.BATCHES).cast("long"))
    at = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}"
    for part in [rows.filter(F.col("batch_index") == i) for i in range(wl.BATCHES)] + [again]:
        part.select("source_id", "batch_index").write.mode("append").parquet(f"{at}/in")
    registry.start(registry.source_stream(spark, f"{at}/in", 8), f"{at}/changes", f"{at}/check", 3).awaitTermination()
    return registry.registry(spark, f"{at}/changes")


# -- postings and frequencies


@query
def postings_rows(spark, sf):
    return postings.postings(wl.sources(spark, sf))


@query
def doc_tokens(spark, sf):
    return postings.doc_tokens(wl.sources(spark, sf)).select("source_index", "token")


@query
def word_df(spark, sf):
    return postings.word_df(wl.sources(spark, sf), clean=True)


@query
def vocabulary(spark, sf):
    return postings.vocabulary(wl.sources(spark, sf), clean=True)


@query
def ranked_words(spark, sf):
    return postings.ranked_words(wl.sources(spark, sf), clean=True)


@query
def expected_words(spark, sf):
    return postings.expected_words(wl.sources(spark, sf), 0.5, clean=True)


@query
def expected_prefix(spark, sf):
    """The prefix of each language's postings, in order of arrival, whose words are frequent next to the first one's."""
    docs = wl.documents(spark, sf).select(F.col("doc_id").alias("source_index"), "lang")
    each = postings.first_places(wl.sources(spark, sf), clean=True).join(docs, "source_index").filter("lang IS NOT NULL")
    # of a word's arrivals the first one decides
    at = F.min(F.struct(F.col("source_index").alias("first"), "nth")).alias("at")
    words = each.groupBy(F.col("lang").alias("scope"), "token").agg(F.count(F.lit(1)).alias("df"), at)
    return postings.expected_prefix(words.select("scope", "at.first", "at.nth", "token", "df"), 0.1)


@query
def seed_word(spark, sf):
    return postings.seed_word(wl.sources(spark, sf), clean=True)


@query
def scope_filter(spark, sf):
    """Words of the labelled documents alone."""
    chosen = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("source_index")).distinct()
    return postings.word_df(wl.sources(spark, sf).join(chosen, "source_index", "left_semi"), clean=True)


@query
def branch_scope(spark, sf):
    """Under the seed word's node: the other words of its sources, with frequencies within them."""
    seed = materialise(postings.seed_word(wl.sources(spark, sf), clean=True).select("token"), "seed")
    rows = postings.doc_tokens(postings.holding(wl.sources(spark, sf), seed), clean=True).select("token")
    return rows.join(F.broadcast(seed), "token", "left_anti").groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query
def known_new_words(spark, sf):
    return postings.known_new(wl.last_batch(spark, sf), wl.words(spark, sf), clean=True)


@query
def batch_word_stats(spark, sf):
    return postings.batch_word_stats(wl.last_batch(spark, sf), wl.words(spark, sf), clean=True)


@query
def batch_trigger_metrics(spark, sf):
    t = ThresholdConfig()
    return postings.batch_trigger_metrics(batch_word_stats(spark, sf), t.alpha, t.beta, (t.alpha_error_threshold, t.beta_error_threshold, t.word_importance_error_threshold))


@query
def containment(spark, sf):
    """For each pair of expected words the share of the one's sources that hold the other."""
    src = wl.sources(spark, sf)
    words = materialise(postings.expected_words(src, 0.5, clean=True).select("token"), "containment-words")
    rows = wl.known_tokens(src).join(F.broadcast(words), "token")  # twice the mean number of words of a source at most, or nearly
    sets = rows.groupBy("source").agg(F.array_sort(F.collect_set("token")).alias("words"))
    pairs = sets.groupBy("words").agg(F.count(F.lit(1)).alias("n")).select("n", "words", F.explode("words").alias("token")).select("n", "token", F.explode("words").alias("other"))
    both = pairs.groupBy("token", "other").agg(F.sum("n").alias("n"))
    size = both.filter("token = other").select("token", F.col("n").alias("size"))
    return both.join(size, "token").select("token", "other", (F.col("n") / F.col("size")).alias("share"))


@query
def refuge_sources(spark, sf):
    return wl.fixed_state(spark, sf).node_sources.filter("node_id = 5").select("source")


@query
def top_words(spark, sf):
    """The seed word, then the first of the words below its node, ten in all."""
    seed = materialise(postings.seed_word(wl.sources(spark, sf), clean=True).select("token"), "seed")
    first = postings.first_places(postings.holding(wl.sources(spark, sf), seed), clean=True).select("source_index", "token", "nth")
    below = first.join(F.broadcast(seed), "token", "left_anti").groupBy("token").agg(F.count(F.lit(1)).alias("df"), *postings.earliest("source_index"))
    return below.orderBy(F.desc("df"), "first", "nth").limit(9).select("token").unionByName(seed)


# -- drift at the root of the fixed tree


@query
def route_batch(spark, sf):
    return wl.fixed_level(spark, sf).routed.select("hkt_id", "node_id", "source")


@query
def scope_df(spark, sf):
    return wl.fixed_level(spark, sf).scope_df


@query
def node_df(spark, sf):
    return wl.fixed_level(spark, sf).node_df


@query
def state0_df(spark, sf):
    return wl.fixed_level(spark, sf).state0_df


@query
def state0_node_postings(spark, sf):
    return wl.fixed_level(spark, sf).state0


@query
def update_stage(spark, sf):
    """Expected words (node 0) and the words that nodes take."""
    level = wl.fixed_level(spark, sf)
    return level.expected.select("hkt_id", F.lit(0).alias("node_id"), "token").unionByName(level.assigned)


@query
def word_change(spark, sf):
    rows = wl.fixed_level(spark, sf).word_change
    return rows.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query
def paper_metrics(spark, sf):
    rows = wl.fixed_level(spark, sf).errors
    return rows.select([F.round(c, 9).alias(c) if c in ("alpha_value", "beta_value", "retained") else F.col(c) for c in rows.columns])


@query
def paper_trigger(spark, sf):
    return wl.fixed_level(spark, sf).decisions("PaperDiagnosticScaffold")


@query
def placeholder_trigger(spark, sf):
    return wl.fixed_level(spark, sf).decisions("Placeholder")


@query
def scope_sizes(spark, sf):
    return wl.fixed_level(spark, sf).scope_sizes


@query
def merge_state1(spark, sf):
    """Sources per node and word once the batch is merged into the root."""
    level = wl.fixed_level(spark, sf)
    state = drift.merged(wl.fixed_state(spark, sf), [level], [level.hkts.select("hkt_id")])
    return state.word_sources.groupBy("node_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query
def next_frontier(spark, sf):
    """The child HKT's sources of the batch."""
    level = wl.fixed_level(spark, sf)
    return level.below(level.hkts.select("hkt_id")).frontier


@query
def window_sources(spark, sf):
    """Sources that a window of three batches keeps in the fixed tree."""
    active = wl.dealt(spark, sf).filter(F.col("batch_index") >= wl.BATCHES - 3).select(F.col("source_index").alias("source"))
    state, _ = prune.light(wl.fixed_state(spark, sf), active)
    return state.node_sources.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


# -- exports and views of the fixed tree


@query
def tree_edges(spark, sf):
    return wl.fixed_tree(spark, sf).edges()


@query
def verbose_nodes(spark, sf):
    tree = wl.fixed_tree(spark, sf)
    rows = tree.nodes().join(tree.node_documents().select("node_id", "sources"), "node_id")
    return rows.select("node_id", "hkt_id", "ord", "refuge", F.array_join(F.transform("words", lambda w: w["token"]), " ").alias("words"), F.array_join(F.transform("sources", lambda s: s["external_source_id"]), ",").alias("sources"))


@query
def verbose_hkts(spark, sf):
    rows = wl.fixed_tree(spark, sf).hkts()
    return rows.select("hkt_id", "parent_node_id", F.array_join(F.col("node_ids").cast("array<string>"), ",").alias("node_ids"), F.array_join("expected_words", " ").alias("expected_words"), F.array_join("words", " ").alias("words"))


@query
def tree_view(spark, sf):
    return views.tree_view(wl.fixed_tree(spark, sf), source_ids=True).drop("date")


@query
def tree_document(spark, sf):
    """The same view of the tree as written to one JSON document and read back."""
    path = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}.json"
    wl.fixed_tree(spark, sf).write_document(path, 100)
    return views.tree_view(export.read_tree(spark, path), source_ids=True).drop("date")


@query
def tree_lines(spark, sf):
    """And of the tree as JSON lines, nodes in parts, read back."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    wl.fixed_tree(spark, sf).write_json(path)
    return views.tree_view(export.read_tree_lines(spark, path), source_ids=True).drop("date")


@query
def event_dates(spark, sf):
    """Dates of events: of their time in milliseconds, and of text where it is a date; values that aren't numbers count 1."""
    rows = spark.read.parquet(f"{sf}/events.parquet")
    odd = F.col("event_id") % 3
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    rows = rows.select(
        "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"), F.when(odd == 0, day).when(odd == 1, "soon").alias("date"),
        F.when(F.col("event_type") == "error", "none").otherwise(F.get_json_object("props", "$.k")).alias("value"),
    )
    made = views.with_defaults(rows, {"topic": "'none'"})
    return made.select("event_id", "date", "value", "topic", views.local_date(F.col("millis")).alias("day"))


@query
def node_paths(spark, sf):
    return views.node_paths(wl.fixed_tree(spark, sf))


@query
def tree_validation(spark, sf):
    return views.validation(wl.fixed_tree(spark, sf))


def _assignments(spark, sf):
    return views.source_assignments(wl.fixed_tree(spark, sf), batches.catalog(wl.baseline(spark, sf)))


@query
def source_assignments(spark, sf):
    return _assignments(spark, sf)


@query
def hkt_treemap(spark, sf):
    return views.treemap(_assignments(spark, sf))


@query
def assign_filter(spark, sf):
    return views.assignment_filter(_assignments(spark, sf), None, 6)


@query
def source_search(spark, sf):
    return views.source_search(_assignments(spark, sf), "DOC_1", by="source_id").select("source_id", "title")


@query
def subtree_filter(spark, sf):
    return views.subtree_filter(views.tree_view(wl.fixed_tree(spark, sf)), None, 1).select("node_id", "label")


@query
def tree_explorer(spark, sf):
    return views.explorer(views.tree_view(wl.fixed_tree(spark, sf)), min_sources=2, max_depth=0).select("node_id", "label", "source_count")


@query
def ancestor_chain(spark, sf):
    s = wl.fixed_state(spark, sf)
    return prune.ancestors(s.hkts, s.nodes, 6)


# -- the tree of the pages' baseline, replay and rebuild


def _nodes(state: drift.State) -> DataFrame:
    words = state.node_words.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("words"))
    held = state.node_sources.groupBy("node_id").agg(F.count(F.lit(1)).alias("sources"))
    return state.nodes.join(held, "node_id").join(words, "node_id", "left")


@query
def tree_nodes(spark, sf):
    return _nodes(wl.engine(spark, sf).state)


@query
def tree_levels(spark, sf):
    """The same tree, every scope handled by Spark, and folded a word at a time where it has more than 50 patterns."""
    e = Engine(spark, wl.config(), small=0, wide=50)
    e.build_baseline(wl.pages(spark, sf).filter(F.col("batch_index") < wl.BATCHES - 1))
    return _nodes(e.state)


@query
def tree_words(spark, sf):
    """Own and top words of the nodes, expected words of the HKTs."""
    e = wl.engine(spark, sf)
    own = e.state.node_words.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "token")
    top = e.top_words.select(F.lit("top").alias("kind"), F.col("node_id").alias("id"), "token")
    return own.unionByName(top).unionByName(e.state.expected.select(F.lit("expected").alias("kind"), F.col("hkt_id").alias("id"), "token"))


@query
def tree_pairs(spark, sf):
    """The sources behind each word of each node."""
    e = wl.engine(spark, sf)
    return e.state.word_sources.join(e.registry, "source").select("node_id", "token", "source_id")


@query
def tree_ids(spark, sf):
    s = wl.engine(spark, sf).state
    own = s.nodes.groupBy("hkt_id").agg(F.min("node_id").alias("first_node"), F.count(F.lit(1)).alias("nodes"))
    return s.hkts.join(own, "hkt_id").select("hkt_id", "parent_node_id", "first_node", "nodes")


@query
def tree_stats(spark, sf):
    return views.validation(wl.engine(spark, sf).tree())


@query
def tree_outline(spark, sf):
    rows = wl.engine(spark, sf).tree().outline_rows()
    return numbered(rows, ["place"], "line", 0).select(F.col("line").cast("int").alias("line"), "text")


#: Thresholds of alpha, beta and word importance by which the pages' last batch triggers some HKTs of several levels.
PLAN_LIMITS = (0.035, 0.02, 0.455)


def _last_level(spark, sf) -> tuple[Engine, drift.Level]:
    """The pages' own tree and its root with the last batch."""
    e = wl.engine(spark, sf)
    names = ("alpha_option1_threshold", "beta_option1_threshold", "word_importance_option1_threshold")
    t = ThresholdConfig(**dict(zip(names, PLAN_LIMITS, strict=True)))
    last = wl.pages(spark, sf).filter(F.col("batch_index") == wl.BATCHES - 1)
    held = last.join(postings.source_ids(last).withColumnRenamed("internal_id", "source"), "source_id")
    return e, drift.root_level(e.state, held.select("source"), e._tokens(held), e._first(), t, e.vocabulary.select("token"))


@query
def trigger_plan(spark, sf):
    """Decisions on all HKTs that the last batch reaches; nothing below a triggered one is."""
    e, level = _last_level(spark, sf)
    return drift.plan(level, e.config.trigger_policy_mode)[0]


@query
def rebuild_plan(spark, sf):
    """The HKTs that the last batch asks to rebuild, with the sources that it brings to each."""
    e, level = _last_level(spark, sf)
    e.last_decisions, e.last_levels, _ = drift.plan(level, e.config.trigger_policy_mode)
    return e.rebuild_plan()


@query
def update_notes(spark, sf):
    """What there is to say of the fixed tree's root after the last batch, in order."""
    return wl.fixed_level(spark, sf).notes("PaperDiagnosticScaffold").select("hkt_id", F.col("line").cast("int").alias("line"), "text")


@query
def timeline_summary(spark, sf):
    """The tree's size after each of eight batches, all of which rebuild it."""
    rows = []
    timeline.replay(Engine(spark, wl.always()), wl.page_sources(spark, sf), wl.BATCHES, lambda i, e: rows.append((i, e.state.hkts.count(), e.state.nodes.count(), e.registry.count())))
    return spark.createDataFrame(rows, "batch_index int, hkts long, nodes long, sources long")


@query
def full_rebuild(spark, sf):
    """Nodes after a batch that always triggers."""
    e = Engine(spark, wl.always())
    e.build_baseline(wl.pages(spark, sf).filter(F.col("batch_index") < wl.BATCHES - 1))
    e.process_batch(wl.pages(spark, sf).filter(F.col("batch_index") == wl.BATCHES - 1), 1)
    return e.state.node_sources.groupBy("node_id").agg(F.count(F.lit(1)).alias("sources"))


@query
def window_batches(spark, sf):
    """Retained batches and registered sources after each of eight batches, by a window of three; all of them rebuild the tree."""
    rows = []
    e = Engine(spark, wl.always(memory_mode="SlidingWindow", max_batches_in_memory=3))
    timeline.replay(e, wl.page_sources(spark, sf), wl.BATCHES, lambda i, e: rows.append((i, e.stored_batch_count, min(e.batches), e.registry.count())))
    return spark.createDataFrame(rows, "batch_index int, stored int, first_batch int, sources long")


@query
def window_prune(spark, sf):
    """What pruning to the last batch but one leaves of the baseline's own tree."""
    e = wl.engine(spark, sf)
    kept = wl.pages(spark, sf).filter(F.col("batch_index") == wl.BATCHES - 2).select("source_id")
    state, _ = prune.light(e.state, e.registry.join(kept, "source_id", "left_semi").select("source"))
    return state.nodes.join(state.node_sources.groupBy("node_id").agg(F.count(F.lit(1)).alias("sources")), "node_id")


def _branch(e: Engine) -> tuple[int, DataFrame, DataFrame]:
    """(the first HKT under the root, no further sources, the words of the node above it)."""
    target = e.state.hkts.filter("parent_node_id <> 0").agg(F.min("hkt_id")).first()[0]
    parent = e.state.hkts.filter(F.col("hkt_id") == target).select(F.col("parent_node_id").alias("node_id"))
    above = e.state.node_words.join(parent, "node_id").select("token")
    return target, above.sparkSession.createDataFrame([], "source long"), above


@query
def rebuild_scope(spark, sf):
    """Frequencies in the scope that a rebuild of the first branch works on."""
    e = wl.engine(spark, sf)
    return e.rebuild_scope(*_branch(e)).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query
def subtree_report(spark, sf):
    """What a rebuild of the first branch would make."""
    e = wl.engine(spark, sf)
    return spark.createDataFrame([tuple(e.dry_run(*_branch(e)).values())], "target_hkt_id int, scoped_source_count long, subtree_hkt_count long, subtree_node_count long, new_token_count_in_scope long")


@query
def subtree_rebuild(spark, sf):
    """The tree after a rebuild of the first branch."""
    e = wl.engine(spark, sf)
    e.rebuild_subtree(*_branch(e))
    return _nodes(e.state).join(e.state.hkts, "hkt_id")


@query
def forest_rebuild(spark, sf):
    """The tree after a rebuild of all HKTs two levels below the root together."""
    e = wl.engine(spark, sf)
    s = e.state
    up = prune.chains(s.hkts, s.nodes, s.hkts)
    targets = materialise(up.groupBy("hkt_id").agg(F.count(F.lit(1)).alias("depth")).filter("depth = 2").select("hkt_id"), "forest-targets")
    above = up.join(targets, "hkt_id", "left_semi").join(s.node_words, "node_id").select("hkt_id", "token")
    e.rebuild_forest([r["hkt_id"] for r in targets.collect()], spark.createDataFrame([], "hkt_id int, source long"), above)
    return _nodes(e.state).join(e.state.hkts, "hkt_id")


@query
def tree_scopes(spark, sf):
    """How many HKTs of each depth there are, and how many different scopes they stand for."""
    src = wl.pages(spark, sf).filter(F.col("batch_index") < wl.BATCHES - 1)
    words = postings.vocabulary(src, clean=True).select("token", "word_id")
    rows = postings.first_places(src, clean=True).join(words, "token").select(F.col("source_index").alias("source"), F.col("word_id").alias("word"), F.col("source_index").alias("first"), "nth")
    made = trees.build(rows, wl.config().builder, small=0)
    return made.scopes.groupBy((F.size("path") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hkts"), F.count_distinct("scope").alias("scopes"))


@query
def rebuild_report(spark, sf):
    """Sources, words, known and new words of each HKT's scope in the last batch."""
    return wl.fixed_level(spark, sf).scope_sizes.select("hkt_id", "scoped_sources", (F.col("known_words") + F.col("new_words")).alias("words"), "known_words", "new_words")


@query
def node_beta(spark, sf):
    return wl.fixed_level(spark, sf).node_vocabulary.withColumn("share", F.round("share", 9))


@query
def paper_inputs(spark, sf):
    rows = wl.fixed_level(spark, sf).inputs
    return rows.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query
def expected_inputs(spark, sf):
    rows = wl.fixed_level(spark, sf).expected_inputs
    return rows.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query
def shadow_reasons(spark, sf):
    """What the paper's gates say of the placeholder policy's figures."""
    return wl.fixed_level(spark, sf).shadow("Placeholder")


@query
def plain_beta(spark, sf):
    return wl.fixed_level(spark, sf).plain_beta.withColumn("beta_error", F.round("beta_error", 9))


@query
def doc_lengths(spark, sf):
    """Number of tokens of each conversation turn as a source, with its place in the conversation."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    order = Window.partitionBy("conv_id").orderBy("turn")
    from driftgrove.functions.text import words

    return turns.select("conv_id", "turn", F.row_number().over(order).cast("long").alias("place"), F.size(words(F.col("text"), STOP_WORDS)).cast("long").alias("n_tokens"))
