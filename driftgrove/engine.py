"""The engine: a baseline tree, batches that are merged into it or rebuild it, retention and state."""

from __future__ import annotations

import functools
import json
import os
import weakref
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrove.config import Config
from driftgrove.errors import StateError
from driftgrove.functions.text import trim
from driftgrove.operators import drift, postings, prune
from driftgrove.operators import tree as trees
from driftgrove.operators.drift import State
from driftgrove.tables import grown, materialise, materialise_all, numbered, parts_of, union_of

NOT_BUILT = "baseline tree has not been built yet"
SCHEMA_VERSION = 1


@dataclass
class BatchResult:
    batch_index: int
    sources_processed: int
    reconstruction_triggered: bool
    notes: list[str] = field(default_factory=list)


@dataclass
class Explanation:
    summary: str
    reason_codes: list[str] = field(default_factory=list)


class Engine:
    """Keeps a tree over the sources of the retained batches.

    ``rebuild_mode``: ``full`` rebuilds everything from the retained batches once an HKT drifts;
    ``hybrid`` does so only if the root is among the drifted HKTs; ``subtree`` never does.
    All tables live in the shared folder; the driver holds counters and references.
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, rebuild_mode: str = "full", small: int = trees.SMALL, wide: int = trees.WIDE):
        self.spark, self.config, self.small, self.wide = spark, config or Config(), small, wide
        self.set_rebuild_mode(rebuild_mode)
        self.state: State | None = None
        self.vocabulary: DataFrame | None = None  # word_id, token
        self.top_words: DataFrame | None = None  # node_id, token, rank
        self.registry: DataFrame | None = None  # source_id, source
        self.batches: dict[int, DataFrame] = {}  # source_index, source_id, source, tokens
        self.words: dict[int, DataFrame] = {}  # token, first, nth, df of each of them: no batch is cut into words twice
        self.members: dict[int, DataFrame] = {}  # source, by batch, of registered batches
        self.last_batch_index: int | None = None
        self.explanation: Explanation | None = None
        self.last_stats: dict | None = None
        self.places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # of tables that are saved already
        self.last_decisions: DataFrame | None = None
        self.last_levels: list[drift.Level] = []
        self.removed: dict[int, int] = {}  # hkt_id: old parent node
        self.rebuilt_from: int | None = None  # the first HKT that a subtree rebuild made
        self.next_hkt_id = self.next_node_id = 1

    # -- modes and accessors

    def set_rebuild_mode(self, mode: str) -> None:
        if mode not in ("full", "hybrid", "subtree"):
            raise ValueError("rebuild_mode must be full, hybrid or subtree")
        self.rebuild_mode = mode

    @property
    def stored_batch_count(self) -> int:
        return len(self.batches)

    def explain_last_update(self) -> Explanation:
        if self.explanation is None:
            raise StateError(NOT_BUILT)
        return self.explanation

    def update_notes(self) -> DataFrame:
        """hkt_id, line, text: notes on every HKT that the last batch reached, as a table since there may be many."""
        if not self.last_levels:
            raise StateError(NOT_BUILT)
        return functools.reduce(DataFrame.unionByName, [x.notes(self.config.trigger_policy_mode) for x in self.last_levels])

    def rebuild_plan(self) -> DataFrame:
        """hkt_id, scoped_sources of the HKTs that the last batch asks to rebuild, each once, all of them in the tree that was measured."""
        if not self.last_levels:
            raise StateError(NOT_BUILT)
        there = functools.reduce(DataFrame.unionByName, [x.hkts.select("hkt_id") for x in self.last_levels])
        return self.last_decisions.filter("triggered").join(there.distinct(), "hkt_id", "left_semi").select("hkt_id", "scoped_sources").distinct()

    def cluster_count(self) -> int:
        """Nodes that aren't refuges."""
        return 0 if self.state is None else self.state.nodes.filter("NOT refuge").count()

    def detect_clusters(self) -> dict:
        """cluster_count and notes, as one document."""
        return {"cluster_count": self.cluster_count(), "notes": [] if self.state else [NOT_BUILT]}

    # -- batches

    def register(self, sources: DataFrame, batch_index: int, clean: bool = False) -> DataFrame:
        """The batch as a table of its own, with trimmed tokens and internal ids; new ids join the registry. ``clean``: the tokens are trimmed already.

        A new id is hashed; only where it meets another one's hash are all ids of the registry settled anew.
        """
        if batch_index < 0:
            raise StateError("batch_index must not be negative")
        tokens = F.col("tokens") if clean else F.filter(F.transform("tokens", trim), lambda w: F.length(w) > 0)
        rows = sources.select("source_index", "source_id", tokens.alias("tokens"))
        new = rows.select("source_id", "source_index")
        if self.registry is None:
            self.registry = materialise(postings.source_ids(new).withColumnRenamed("internal_id", "source"), "engine-registry")
        else:
            fresh = materialise(new.join(self.registry.select("source_id"), "source_id", "left_anti"), "engine-fresh")
            ids = postings.source_ids(fresh).withColumnRenamed("internal_id", "source")
            if ids.join(self.registry.select("source"), "source", "left_semi").limit(1).count():  # a new id hashes like an old one
                both = self.registry.select("source_id", F.lit(-1).cast("long").alias("source_index")).unionByName(fresh.select("source_id", F.col("source_index").cast("long")))
                settled = postings.source_ids(both).withColumnRenamed("internal_id", "source").join(self.registry.withColumnRenamed("source", "old"), "source_id", "left")
                self.registry = materialise(settled.select("source_id", F.coalesce("old", "source").alias("source")), "engine-registry")
            else:
                self.registry = grown(self.registry, ids, "engine-registry")
        held = materialise(rows.join(self.registry, "source_id").select("source_index", "source_id", "source", "tokens"), "engine-batch")
        self.members[batch_index] = held.select("source").distinct()
        return held

    def _summarise(self, batch_index: int, held: DataFrame) -> None:
        self.words[batch_index] = materialise(postings.first_and_df(held, clean=True), "engine-words")

    def source_batches(self) -> DataFrame:
        """source_id, last_batch, batches: of the registered batches that are kept, those that a source is in."""
        each = functools.reduce(DataFrame.unionByName, [m.withColumn("batch", F.lit(i).cast("long")) for i, m in self.members.items()])
        held = each.groupBy("source").agg(F.max("batch").alias("last_batch"), F.count(F.lit(1)).alias("batches"))
        return self.registry.join(held, "source").select("source_id", "last_batch", "batches")

    def _tokens(self, batch: DataFrame) -> DataFrame:
        return postings.doc_tokens(batch, clean=True).join(batch.select("source_id", "source").distinct(), "source_id").select("source", "token").distinct()

    def _first(self) -> DataFrame:
        """source, token: the known words of the first retained batch."""
        rows = self._tokens(self.batches[min(self.batches)])
        return materialise(rows.join(self.vocabulary.select("token"), "token", "left_semi").select("source", "token"), "engine-first")

    def _first_df(self) -> DataFrame | None:
        """token, df of ``_first``, from the batch's summary."""
        words = self.words.get(min(self.batches))
        return None if words is None else words.join(self.vocabulary.select("token"), "token", "left_semi").select("token", "df")

    def _moves(self, batches: dict[int, DataFrame]) -> dict[int, int] | None:
        """By how much the indices of each batch are moved so that a later batch follows an earlier one; None if that doesn't fit 64 bits."""
        order = sorted(batches)
        if len(order) == 1:
            return {order[0]: 0}
        ends = functools.reduce(DataFrame.unionByName, [batches[i].agg(F.lit(i).alias("i"), F.min("source_index").alias("low"), F.max("source_index").alias("high")) for i in order])
        spans = {r["i"]: (r["low"], r["high"]) for r in ends.collect() if r["low"] is not None}  # a row per batch
        start, moves = -(1 << 62), {}
        for i in order:
            low, high = spans.get(i, (0, -1))
            moves[i] = start - low
            start += high - low + 1
        return moves if start < 1 << 62 and all(abs(m) < 1 << 63 for m in moves.values()) else None

    def _arrivals(self, batches: dict[int, DataFrame]) -> DataFrame:
        """source_index (over all batches), source_id, source, tokens: a later batch follows an earlier one.

        Each batch is moved behind the one before it by the range of its own indices; where the ranges are
        too wide together for 64 bits, the sources of each are numbered first.
        """
        moves = self._moves(batches)
        if moves is None:
            batches = {i: numbered(b, ["source_index"], "source_index", 0) for i, b in batches.items()}
            moves = self._moves(batches)
        parts = [batches[i].withColumn("source_index", F.col("source_index") + F.lit(by)) if by else batches[i] for i, by in moves.items()]
        return functools.reduce(DataFrame.unionByName, parts)

    def _vocabulary(self, arrivals: DataFrame) -> DataFrame:
        """word_id, token of the retained batches, by first appearance: from their summaries where their indices fit."""
        moves = self._moves(self.batches)
        if moves is None or set(moves) - set(self.words):
            return postings.vocabulary(arrivals, clean=True).select("word_id", "token")
        words = postings.merged_words([(self.words[i], by) for i, by in moves.items()])
        return numbered(words, ["first", "nth"], "word_id").select(F.col("word_id").cast("int").alias("word_id"), "token")

    def _build(self, arrivals: DataFrame) -> None:
        """Words, tree and state from ``arrivals``, all sources of the retained batches."""
        self.vocabulary = materialise(self._vocabulary(arrivals), "engine-vocabulary")
        placed = postings.first_places(arrivals, clean=True, keep=("source",))
        rows = placed.join(self.vocabulary, "token").groupBy("source", F.col("word_id").alias("word")).agg(*postings.earliest("source_index"))
        tree = trees.build(rows, self.config.builder, self.small, wide=self.wide)
        self.state, self.top_words = self._named(tree, self.vocabulary)
        self.removed, self.rebuilt_from = {}, None
        most = self.state.nodes.agg(F.max("hkt_id").alias("h"), F.max("node_id").alias("n")).first()
        self.next_hkt_id, self.next_node_id = (most["h"] or 0) + 1, (most["n"] or 0) + 1

    def _named(self, tree: trees.Tree, vocabulary: DataFrame) -> tuple[State, DataFrame]:
        token = vocabulary.select("word_id", "token")
        tables = State(
            tree.hkts,
            tree.nodes.select("node_id", "hkt_id", "ord", "refuge"),
            tree.node_words.filter("word_id <> -1").join(token, "word_id").select("node_id", "token", "word_id"),
            tree.node_sources,
            tree.word_sources.join(token, "word_id").select("node_id", "token", "source"),
            tree.expected.join(token, "word_id").select("hkt_id", "token"),
        )
        top = tree.top_words.join(token, "word_id").select("node_id", "token", "rank")
        *kept, top = materialise_all({f"state-{f}": getattr(tables, f) for f in State.__dataclass_fields__} | {"engine-top": top})
        return State(*kept), top

    def build_baseline(self, sources: DataFrame, batch_index: int = 0) -> BatchResult:
        """A new tree over the sources; forgets what was there before."""
        self.registry, self.batches, self.words, self.members = None, {}, {}, {}
        held = self.register(sources, batch_index)
        n = held.count()
        if not n:
            raise StateError("baseline batch has no sources")
        self.batches = {batch_index: held}
        self._summarise(batch_index, held)
        self._build(held)
        self.last_batch_index, self.last_stats = batch_index, None
        self.explanation = Explanation("Baseline initialized", ["BASELINE_INITIALIZED", "HKT_BUILDER_PHASE1"])
        return BatchResult(batch_index, n, False, [f"Baseline HKTs: {self.state.hkts.count()}", f"Baseline nodes: {self.state.nodes.count()}"])

    def process_batch(self, sources: DataFrame, batch_index: int) -> BatchResult:
        """Measures the batch against the tree, then merges it or rebuilds, trims and prunes."""
        if self.state is None or not self.batches:
            raise StateError(NOT_BUILT)
        if batch_index <= self.last_batch_index:
            raise StateError(f"batch_index {batch_index} must be greater than last processed batch index {self.last_batch_index}")
        if batch_index != self.last_batch_index + 1:
            raise StateError(f"batch_index {batch_index} is out of sequence; expected {self.last_batch_index + 1}")
        window = self.config.window
        held = self.register(sources, batch_index)
        notes = []
        self._summarise(batch_index, held)
        stats = postings.batch_word_stats(held, self.vocabulary, words=self.words[batch_index])
        self.last_stats = stats.first().asDict()
        notes.append("Batch word stats: unique={unique_words}, known={known_words}, new={new_words}, max_df={max_df}, sources={sources}".format(**self.last_stats))
        t = self.config.thresholds
        seen = postings.batch_trigger_metrics(stats, t.alpha, t.beta, (t.alpha_error_threshold, t.beta_error_threshold, t.word_importance_error_threshold)).first()
        notes.append(f"Batch trigger metrics: alpha_err={seen['alpha_error']:.4f}, beta_err={seen['beta_error']:.4f}, word_importance_error={seen['word_importance_error']:.4f}")
        tokens = materialise(self._tokens(held), "engine-tokens")
        level = drift.root_level(self.state, held.select("source"), tokens, self._first(), t, self.vocabulary.select("token"), self._first_df())
        decisions, levels, accepted = drift.plan(level, self.config.trigger_policy_mode)
        self.last_decisions, self.last_levels = decisions, levels
        # the HKTs of the plan, not their contents
        triggered = sorted((r["hkt_id"], r["reasons"]) for r in decisions.filter("triggered").select("hkt_id", "reasons").collect())
        notes += [f"HKT {h} trigger reason: {x}" for h, r in triggered for x in r.split(",")]
        anew = bool(triggered) and self._rebuilds_all([h for h, _ in triggered])
        if not anew:  # what is merged would go with the old tree
            self.state = drift.merged(self.state, levels, accepted)
        self.batches[batch_index] = held
        if window:
            self.batches = {i: b for i, b in self.batches.items() if i > batch_index - window}
            self.words = {i: w for i, w in self.words.items() if i in self.batches}
        kept = f", max: {window}" if window else ""
        notes.append(f"Memory mode: {self.config.memory_mode} (stored batches: {len(self.batches)}{kept})")
        codes = ["INCREMENTAL_BATCH_PROCESSED", "BATCH_WORD_STATS_COMPUTED", "SCOPE_MAPPING_COMPLETED", "SCOPE_METRICS_COMPUTED", "TRIGGER_EVALUATED"]
        if triggered:
            codes += ["RECONSTRUCTION_TRIGGERED", "REBUILD_ACTION_REQUESTED", self._rebuild([h for h, _ in triggered], levels)]
        else:
            codes.append("RECONSTRUCTION_SKIPPED")
        if window:
            # a tree built anew from the window's batches holds none but their sources
            report = {"nodes": 0, "hkts": 0, "active": self.registry.count(), "sources": 0} if anew else self._prune(batch_index - window + 1)
            notes.append(f"Pruning: active sources={report['active']}, pruned sources={report['sources']}, nodes={report['nodes']}, HKTs={report['hkts']}")
            codes.append("WINDOW_PRUNING_APPLIED")
        self.last_batch_index = batch_index
        self.explanation = Explanation(f"Batch {batch_index} processed", codes)
        return BatchResult(batch_index, self.last_stats["sources"], bool(triggered), notes)

    # -- rebuilding

    def _rebuilds_all(self, targets: list[int]) -> bool:
        """Whether a rebuild of ``targets`` is one of everything."""
        if self.rebuild_mode != "hybrid":
            return self.rebuild_mode == "full"
        return self.state.hkts.filter("parent_node_id = 0").agg(F.min("hkt_id")).first()[0] in targets

    def _rebuild(self, targets: list[int], levels: list[drift.Level]) -> str:
        if self._rebuilds_all(targets):
            self.rebuild_all()
            return "FULL_REBUILD_EXECUTED" if self.rebuild_mode == "full" else "HYBRID_REBUILD_FALLBACK_EXECUTED"
        self.rebuild_forest(targets, *(functools.reduce(DataFrame.unionByName, x) for x in zip(*((x.frontier.select("hkt_id", "source"), x.accepted.select("hkt_id", "token")) for x in levels), strict=True)))
        return "SELECTED_REBUILD_EXECUTED"

    def rebuild_all(self) -> None:
        """The tree anew from the retained batches; words are numbered anew and sources registered again."""
        batches, self.registry, self.members = self.batches, None, {}
        arrivals = self._arrivals(batches)
        ids = postings.source_ids(arrivals.select("source_id", "source_index")).withColumnRenamed("internal_id", "source")
        self.registry = materialise(ids, "engine-registry")
        named = {f"engine-batch-{i}": b.drop("source").join(self.registry, "source_id").select("source_index", "source_id", "source", "tokens") for i, b in batches.items()}
        self.batches = dict(zip(batches, materialise_all(named), strict=True))
        self.members = {i: b.select("source").distinct() for i, b in self.batches.items()}
        self._build(self._arrivals(self.batches))

    def rebuild_scopes(self, targets: DataFrame, scoped: DataFrame, above: DataFrame) -> DataFrame:
        """hkt_id, source, token, late, first, nth: postings that a rebuild of each HKT of ``targets`` works on; late, first and nth are their order of arrival.

        They come from the retained batches, for an HKT's own sources and the ``scoped`` ones (hkt_id,
        source), without known words among those of the nodes ``above`` (hkt_id, token).
        """
        nodes = self.state.nodes.join(targets.select("hkt_id"), "hkt_id").select("hkt_id", "node_id")
        own = self.state.node_sources.join(nodes, "node_id").select("hkt_id", "source").distinct()
        late = scoped.select("hkt_id", "source").distinct().join(targets.select("hkt_id"), "hkt_id", "left_semi").join(own, ["hkt_id", "source"], "left_anti")
        # sources that the HKT lacks come last
        chosen = own.withColumn("late", F.lit(0)).unionByName(late.withColumn("late", F.lit(1)))
        known = above.join(self.vocabulary.select("token"), "token", "left_semi").select("hkt_id", "token").distinct()
        held = self._arrivals(self.batches).join(chosen, "source")
        rows = postings.first_places(held, clean=True, keep=("hkt_id", "source", "late")).join(known, ["hkt_id", "token"], "left_anti")
        return rows.groupBy("hkt_id", "source", "token").agg(F.min("late").alias("late"), *postings.earliest("source_index"))

    def rebuild_scope(self, target: int, scoped: DataFrame, above: DataFrame) -> DataFrame:
        """The same of one HKT, its ``scoped`` (source) and what is ``above`` (token), without hkt_id."""
        one = F.lit(target).alias("hkt_id")
        return self.rebuild_scopes(self._hkts([target]), scoped.select(one, "source"), above.select(one, "token")).drop("hkt_id")

    def _hkts(self, targets: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in targets], "hkt_id int")

    def dry_run(self, target: int, scoped: DataFrame, above: DataFrame) -> dict:
        """What a rebuild of the HKT would work on and make; nothing changes."""
        scope = materialise(self.rebuild_scope(target, scoped, above), "engine-scope")
        new_tokens = scope.select("token").distinct().join(self.vocabulary.select("token"), "token", "left_anti").count()
        sources = scope.select("source").distinct().count()
        report = {"target_hkt_id": target, "scoped_source_count": sources, "subtree_hkt_count": 0, "subtree_node_count": 0, "new_token_count_in_scope": new_tokens}
        if sources:
            ordered = numbered(scope, ["late", "first", "nth"], "place")
            ids = numbered(ordered.groupBy("token").agg(F.min("place").alias("first")), ["first"], "word")
            rows = ordered.join(ids, "token").select("source", F.col("word").cast("int").alias("word"), F.col("place").alias("first"), F.lit(0).alias("nth"))
            tree = trees.build(rows, self.config.builder, self.small, arrival=True, wide=self.wide)
            report |= {"subtree_hkt_count": tree.hkts.count(), "subtree_node_count": tree.nodes.count()}
        return report

    def rebuild_hkts(self, targets: list[int], sources: DataFrame) -> str:
        """Rebuilds the given HKTs by the rebuild mode; ``sources`` (source_id), routed down the tree, are what the batch brings to each."""
        held = sources.select("source_id").join(self.registry, "source_id").select("source")
        batch = self.batches[max(self.batches)]
        level = drift.root_level(self.state, held, materialise(self._tokens(batch), "engine-tokens"), self._first(), self.config.thresholds, self.vocabulary.select("token"))
        levels = []
        while level is not None:
            levels.append(level)
            level = level.below(level.hkts.select("hkt_id"))
        reached = {r["hkt_id"] for x in levels for r in x.hkts.select("hkt_id").collect()}  # HKTs of the tree
        if unknown := [t for t in targets if t not in reached]:
            raise StateError(f"the batch reaches no HKT {unknown}")
        return self._rebuild(sorted(set(targets)), levels)

    def rebuild_subtree(self, target: int, scoped: DataFrame, above: DataFrame) -> bool:
        """Builds the HKT and all below it anew. False if nothing is left to build from."""
        one = F.lit(target).alias("hkt_id")
        return bool(self.rebuild_forest([target], scoped.select(one, "source"), above.select(one, "token")))

    def rebuild_forest(self, targets: list[int], scoped: DataFrame, above: DataFrame) -> list[int]:
        """Builds the given HKTs and all below them anew, as one forest; ids follow their order and aren't used again.

        ``scoped``: hkt_id, source that the batch brings to them; ``above``: hkt_id, token of the nodes above. An
        HKT below another one of ``targets`` goes with that one, and one with nothing left to build
        from stays. Returns those that were built. The number of jobs doesn't depend on how many they are.
        """
        s = self.state
        chains = materialise(prune.chains(s.hkts, s.nodes, self._hkts(targets)), "engine-chains")
        inner = chains.join(s.nodes.select("node_id", F.col("hkt_id").alias("outer")), "node_id").join(self._hkts(targets).withColumnRenamed("hkt_id", "outer"), "outer", "left_semi")
        nested = {r["hkt_id"] for r in inner.select("hkt_id").distinct().collect()}  # of the targets
        there = self.spark.createDataFrame([(t,) for t in sorted(set(targets) - nested)], "hkt_id int")
        parents = {r["hkt_id"]: r["parent_node_id"] for r in s.hkts.join(there, "hkt_id").select("hkt_id", "parent_node_id").collect()}
        scope = materialise(self.rebuild_scopes(there, scoped, above), "engine-scope")
        built = sorted(r["hkt_id"] for r in scope.select("hkt_id").distinct().collect() if r["hkt_id"] in parents)
        if not built:
            return []
        live = self._hkts(built)
        ordered = numbered(scope, ["hkt_id", "late", "first", "nth"], "place")
        # tokens without an id count down from the largest, in order of arrival
        new = ordered.join(self.vocabulary.select("token"), "token", "left_anti").groupBy("hkt_id", "token").agg(F.min("place").alias("first"))
        made = numbered(new, ["first"], "n", 0).select("hkt_id", "token", (F.lit(2147483647) - F.col("n")).cast("int").alias("made"))
        rows = ordered.join(self.vocabulary.select("token", "word_id"), "token", "left").join(made, ["hkt_id", "token"], "left")
        name = lambda c: F.concat(F.lit("t"), c)
        rows = rows.select(name(F.col("hkt_id")).alias("scope"), "source", F.coalesce("word_id", "made").alias("word"), F.col("place").alias("first"), F.lit(0).alias("nth"))
        tree = trees.build(rows, self.config.builder, self.small, arrival=True, wide=self.wide, roots=[f"t{t}" for t in built])
        words = materialise(self.vocabulary.select("token", "word_id").unionByName(made.select("token", F.col("made").alias("word_id"))), "engine-words")
        fresh, top = self._named(tree, words)
        dead = prune.subtree(s.hkts, s.nodes, live)
        dead_nodes = materialise(s.nodes.join(dead, "hkt_id").select("node_id"), "engine-dead")
        dh, dn = self.next_hkt_id - 1, self.next_node_id - 1
        node = (F.col("node_id") + dn).cast("int").alias("node_id")
        hkt = (F.col("hkt_id") + dh).cast("int").alias("hkt_id")
        hung = self.spark.createDataFrame([(f"t{t}", parents[t]) for t in built], "scope string, above int")
        roots = tree.scopes.filter(F.size("path") == 1).join(hung, "scope").select("hkt_id", "above")
        hkts = fresh.hkts.join(roots, "hkt_id", "left").select(hkt, F.coalesce("above", F.col("parent_node_id") + dn).cast("int").alias("parent_node_id"))
        late = scoped.select("hkt_id", "source").distinct().join(live, "hkt_id", "left_semi").join(chains, "hkt_id").select("node_id", "source")
        keep = lambda df: df.join(dead_nodes, "node_id", "left_anti")
        self.state = State(
            s.hkts.join(dead, "hkt_id", "left_anti").select("hkt_id", "parent_node_id").unionByName(hkts),
            keep(s.nodes).select("node_id", "hkt_id", "ord", "refuge").unionByName(fresh.nodes.select(node, hkt, "ord", "refuge")),
            keep(s.node_words).select("node_id", "token", "word_id").unionByName(fresh.node_words.select(node, "token", "word_id")),
            keep(s.node_sources).select("node_id", "source").unionByName(late).distinct().unionByName(fresh.node_sources.select(node, "source")),
            keep(s.word_sources).select("node_id", "token", "source").unionByName(fresh.word_sources.select(node, "token", "source")),
            s.expected.join(dead, "hkt_id", "left_anti").select("hkt_id", "token").unionByName(fresh.expected.select(hkt, "token")),
        ).kept()
        self.top_words = materialise(keep(self.top_words).select("node_id", "token", "rank").unionByName(top.select(node, "token", "rank")), "engine-top")
        self.removed |= {t: parents[t] for t in built}
        self.rebuilt_from = dh + 1 if self.rebuilt_from is None else self.rebuilt_from
        most = self.state.nodes.agg(F.max("hkt_id").alias("h"), F.max("node_id").alias("n")).first()
        self.next_hkt_id, self.next_node_id = max(self.next_hkt_id, most["h"] + 1), max(self.next_node_id, most["n"] + 1)
        return built

    # -- retention

    def _prune(self, start: int) -> dict:
        before = self.registry.count()
        self.members = {i: m for i, m in self.members.items() if i >= start}
        active = None
        for m in self.members.values():
            active = m if active is None else active.unionByName(m)
        active = materialise(active.distinct(), "engine-active")
        self.state, report = prune.light(self.state, active)
        self.registry = materialise(self.registry.join(active, "source", "left_semi").select("source_id", "source"), "engine-registry")
        return report | {"active": active.count(), "sources": before - self.registry.count()}

    # -- state on disk

    def snapshot(self) -> dict:
        """Metadata only."""
        return {"schema_version": SCHEMA_VERSION, "engine_version": "0.1.0", "config": self.config.to_dict(), "last_batch_index": self.last_batch_index, "logically_removed_hkts": {str(k): v for k, v in self.removed.items()}}

    def save(self, path: str) -> None:
        """The engine under ``path``: tables and parts of tables that no earlier save has, then the control file, which names all of them and makes them valid.

        What is saved already stays where it is, in the folder of an earlier version. Batches that are merged add a part to
        the tables that grow with the sources, so a version writes about as much as its batch brought.
        """
        if self.state is None:
            raise StateError(NOT_BUILT)
        tables = {f"state-{f}": getattr(self.state, f) for f in State.__dataclass_fields__} | {"vocabulary": self.vocabulary, "top_words": self.top_words, "registry": self.registry}
        tables |= {f"batch-{i}": b for i, b in self.batches.items()} | {f"words-{i}": w for i, w in self.words.items()} | {f"members-{i}": m for i, m in self.members.items()}
        places: dict[str, list[str]] = {}
        for name, df in tables.items():
            for part in parts_of(df):
                if part not in self.places:
                    place = f"{path}/{name}-{len(places.get(name, []))}"
                    part.write.mode("overwrite").parquet(place)
                    self.places[part] = place
                places.setdefault(name, []).append(self.places[part])
        control = self.snapshot() | {"tables": places, "batches": sorted(self.batches), "words": sorted(self.words), "members": sorted(self.members), "rebuild_mode": self.rebuild_mode, "next_hkt_id": self.next_hkt_id, "next_node_id": self.next_node_id, "rebuilt_from": self.rebuilt_from, "reason_codes": self.explanation.reason_codes, "summary": self.explanation.summary}
        self.spark.createDataFrame([(json.dumps(control),)], "control string").coalesce(1).write.mode("overwrite").text(f"{path}/control")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        control = json.loads(spark.read.text(f"{path}/control").first()[0])
        engine = cls(spark, Config.from_dict(control["config"]), control["rebuild_mode"])

        def read(name: str) -> DataFrame:
            parts = [spark.read.parquet(place) for place in control["tables"][name]]
            engine.places.update(zip(parts, control["tables"][name], strict=True))
            return union_of(parts)

        engine.state = State(*[read(f"state-{f}") for f in State.__dataclass_fields__])
        engine.vocabulary, engine.top_words, engine.registry = read("vocabulary"), read("top_words"), read("registry")
        engine.batches = {i: read(f"batch-{i}") for i in control["batches"]}
        engine.words = {i: read(f"words-{i}") for i in control.get("words", [])}
        engine.members = {i: read(f"members-{i}") for i in control["members"]}
        engine.last_batch_index = control["last_batch_index"]
        engine.next_hkt_id, engine.next_node_id, engine.rebuilt_from = control["next_hkt_id"], control["next_node_id"], control["rebuilt_from"]
        engine.removed = {int(k): v for k, v in control["logically_removed_hkts"].items()}
        engine.explanation = Explanation(control["summary"], control["reason_codes"])
        return engine

    @classmethod
    def from_snapshot(cls, spark: SparkSession, raw: dict) -> Engine:
        """An engine with a snapshot's metadata; it has no tree and processes no batches."""
        engine = cls(spark, Config.from_dict(raw["config"]))
        engine.last_batch_index = raw["last_batch_index"]
        engine.removed = {int(k): v for k, v in raw["logically_removed_hkts"].items()}
        return engine

    # -- exports

    def tree(self):
        """The tree as tables and JSON."""
        from driftgrove.operators.export import TreeExport

        if self.state is None:
            raise StateError(NOT_BUILT)
        return TreeExport(self.state, self.vocabulary, self.top_words, self.registry, dict(self.removed), self.rebuilt_from)


def save_json(document: dict, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump(document, f, indent=2, ensure_ascii=False)


__all__ = ["BatchResult", "Engine", "Explanation", "save_json"]
