"""Routing a batch down the tree and measuring how far it drifts from it, a level of HKTs at a time.

Every function works on all HKTs of a level together: rows carry hkt_id or node_id. Words are known
by their token, so a token that the vocabulary lacks needs no id of its own.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from driftgrove.config import ThresholdConfig
from driftgrove.functions.text import round_half_away
from driftgrove.tables import grown, materialise, materialise_all


@dataclass(frozen=True)
class State:
    """A tree version, by token. Refuge nodes have no words and no word sources."""

    hkts: DataFrame  # hkt_id, parent_node_id (0: root)
    nodes: DataFrame  # node_id, hkt_id, ord, refuge
    node_words: DataFrame  # node_id, token, word_id
    node_sources: DataFrame  # node_id, source
    word_sources: DataFrame  # node_id, token, source
    expected: DataFrame  # hkt_id, token

    def kept(self, name: str = "state") -> State:
        """The same, as tables of their own."""
        return State(*materialise_all({f"{name}-{f}": getattr(self, f) for f in self.__dataclass_fields__}))


@dataclass(frozen=True)
class Level:
    """What a batch means to the HKTs of one level.

    frontier: hkt_id, source. tokens: source, token (of the batch). first: source, token (known words
    of the first retained batch). accepted: hkt_id, token (words of the nodes above). Each derived
    table is declared once and shared by those that follow.
    """

    state: State
    frontier: DataFrame
    tokens: DataFrame
    first: DataFrame
    accepted: DataFrame
    thresholds: ThresholdConfig
    #: token: the vocabulary that tells known from new words; by default the words of all nodes.
    known: DataFrame | None = None
    #: token, df of ``first``, where that is known already.
    first_df: DataFrame | None = None

    @functools.cached_property
    def hkts(self) -> DataFrame:
        return materialise(self.state.hkts.join(self.frontier.select("hkt_id").distinct(), "hkt_id"), "drift-hkts")

    @functools.cached_property
    def nodes(self) -> DataFrame:
        return self.state.nodes.join(self.hkts.select("hkt_id"), "hkt_id")

    @functools.cached_property
    def words(self) -> DataFrame:
        """hkt_id, node_id, ord, token, word_id of nodes that aren't refuges.

        As a table its size is known, so that a join broadcasts it only where it is small.
        """
        return materialise(self.nodes.filter("NOT refuge").select("hkt_id", "node_id", "ord").join(self.state.node_words, "node_id"), "drift-words")

    @functools.cached_property
    def hits(self) -> DataFrame:
        """hkt_id, node_id, token, source: the words that a source of the HKT shares with a node.

        A source's tokens meet the nodes' words first, which are few, so that its other tokens are never
        repeated for the HKTs and nodes that it reaches.
        """
        at = self.words.select("hkt_id", "node_id", "token")
        met = self.tokens.join(at, "token").join(self.frontier, ["hkt_id", "source"])
        return materialise(met.select("hkt_id", "node_id", "token", "source"), "drift-hits")

    @functools.cached_property
    def routed(self) -> DataFrame:
        """hkt_id, node_id, source: nodes that share a word with the source, else the HKT's refuge."""
        hit = self.hits.select("hkt_id", "node_id", "source").distinct()
        refuge = self.nodes.filter("refuge").select("hkt_id", "node_id")
        missed = self.frontier.join(hit, ["hkt_id", "source"], "left_anti").join(refuge, "hkt_id")
        return materialise(hit.unionByName(missed.select("hkt_id", "node_id", "source")), "drift-routed")

    @functools.cached_property
    def scope_df(self) -> DataFrame:
        """hkt_id, token, df1: sources of the batch in the HKT's scope that hold the token."""
        return materialise(self.frontier.join(self.tokens, "source").groupBy("hkt_id", "token").agg(F.count(F.lit(1)).alias("df1")), "drift-df")

    @functools.cached_property
    def node_df(self) -> DataFrame:
        """hkt_id, node_id, token, df1 among the sources routed to the node, refuges included."""
        return self.routed.join(self.tokens, "source").groupBy("hkt_id", "node_id", "token").agg(F.count(F.lit(1)).alias("df1"))

    @functools.cached_property
    def state0_df(self) -> DataFrame:
        """hkt_id, token, df0: sources of the first batch in the parent node (all for the root) that hold the word."""
        roots, others = self.hkts.agg(F.count_if(F.col("parent_node_id") == 0), F.count_if(F.col("parent_node_id") != 0)).first()
        counts = self.first.groupBy("token").agg(F.count(F.lit(1)).alias("df0")) if self.first_df is None else self.first_df.select("token", F.col("df").alias("df0"))
        root = counts.crossJoin(F.broadcast(self.hkts.filter("parent_node_id = 0").select("hkt_id").limit(1))).select("hkt_id", "token", "df0")
        if roots and not others:  # no source of the first batch is met
            return root if self.first_df is not None else materialise(root, "drift-df0")
        above = self.hkts.filter("parent_node_id <> 0").join(self.state.node_sources.withColumnRenamed("node_id", "parent_node_id"), "parent_node_id")
        below = above.select("hkt_id", "source").join(self.first, "source").groupBy("hkt_id", "token").agg(F.count(F.lit(1)).alias("df0"))
        return materialise(root.unionByName(below) if roots else below, "drift-df0")

    @functools.cached_property
    def state0(self) -> DataFrame:
        """hkt_id, node_id, token, source: first-batch sources of a node, by the node's own words."""
        held = self.first.join(self.words.select("hkt_id", "node_id", "token"), "token").join(self.state.node_sources, ["node_id", "source"])
        return materialise(held.select("hkt_id", "node_id", "token", "source"), "drift-state0")

    @functools.cached_property
    def wanted(self) -> DataFrame:
        """hkt_id, node_id, token, source of the batch's sources routed to a node, by those of their tokens that the HKT expects."""
        met = self.tokens.join(self.expected.select("hkt_id", "token"), "token")
        return met.join(self.routed, ["hkt_id", "source"]).select("hkt_id", "node_id", "token", "source")

    @functools.cached_property
    def fresh(self) -> DataFrame:
        """hkt_id, node_id, token, source of the batch's sources routed to a node, by the node's own and assigned words."""
        taken = self.wanted.join(self.assigned.select("node_id", "token"), ["node_id", "token"], "left_semi")
        return materialise(self.hits.unionByName(taken).distinct(), "drift-fresh")

    @functools.cached_property
    def lead_words(self) -> DataFrame:
        """node_id, token: the smallest word id of each node."""
        return self.words.groupBy("hkt_id", "node_id", "ord").agg(F.min_by("token", "word_id").alias("token"))

    @functools.cached_property
    def lead(self) -> DataFrame:
        """hkt_id, node_id, token of the first node's smallest word."""
        return self.lead_words.groupBy("hkt_id").agg(F.min_by(F.struct("node_id", "token"), "ord").alias("x")).select("hkt_id", "x.node_id", "x.token")

    def counts(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("node_id", "token").agg(F.count(F.lit(1)).alias(name))

    @functools.cached_property
    def expected(self) -> DataFrame:
        """hkt_id, token, total: the expected words after admission and the alpha test; total = df0 + df1."""
        lead0 = self.lead.join(self.counts(self.state0, "n"), ["node_id", "token"], "left").select("hkt_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("p"))
        held = self.words.select("hkt_id", "token").unionByName(self.accepted.select("hkt_id", "token"))
        both = F.coalesce("df0", F.lit(0)) + F.coalesce("df1", F.lit(0))
        seen = self.scope_df.join(self.state0_df, ["hkt_id", "token"], "left").select("hkt_id", "token", both.alias("total"))
        new = seen.join(held, ["hkt_id", "token"], "left_anti").join(lead0, "hkt_id", "left")
        admitted = new.filter(F.col("total") / F.coalesce("p", F.lit(1)) >= self.thresholds.alpha).select("hkt_id", "token")
        before = self.state.expected.join(self.hkts.select("hkt_id"), "hkt_id")
        every = materialise(before.select("hkt_id", "token").unionByName(admitted).distinct(), "drift-every")
        rows = every.join(self.scope_df, ["hkt_id", "token"], "left").join(self.state0_df, ["hkt_id", "token"], "left").select("hkt_id", "token", both.alias("total"))
        own = self.words.join(self.counts(self.state0, "n0"), ["node_id", "token"], "left").join(self.counts(self.hits, "n1"), ["node_id", "token"], "left")
        most_own = own.groupBy("hkt_id").agg(F.max(F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("a"))
        most = rows.groupBy("hkt_id").agg(F.max("total").alias("b")).join(most_own, "hkt_id", "left").select("hkt_id", F.greatest("a", "b", F.lit(1)).alias("most"))
        return materialise(rows.join(most, "hkt_id").filter(F.col("total") / F.col("most") >= self.thresholds.alpha).select("hkt_id", "token", "total"), "drift-expected")

    @functools.cached_property
    def assigned(self) -> DataFrame:
        """hkt_id, node_id, token: expected words that a matched node takes by the beta test."""
        matched = self.routed.join(self.nodes.filter("NOT refuge").select("node_id"), "node_id", "left_semi")
        own = self.words.select("node_id", "token", "word_id")
        both = self.state0.select("node_id", "token", "source").unionByName(self.hits.select("node_id", "token", "source")).distinct().join(own, ["node_id", "token"])
        sizes = both.groupBy("node_id", "token", "word_id").agg(F.count(F.lit(1)).alias("n"))
        best = sizes.groupBy("node_id").agg(F.max_by("token", F.struct("n", (-F.col("word_id")).alias("w"))).alias("token"))
        prominent = both.join(best, ["node_id", "token"], "left_semi").select("node_id", "source")
        rest = matched.join(best, "node_id", "left_anti").select("node_id", "source")
        prominent = prominent.unionByName(rest).distinct()
        size = prominent.groupBy("node_id").agg(F.count(F.lit(1)).alias("size"))
        wanted = self.wanted.join(matched.select("node_id").distinct(), "node_id")
        share = wanted.join(prominent.withColumn("p", F.lit(1)), ["node_id", "source"], "left").groupBy("hkt_id", "node_id", "token").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n"))
        ok = share.join(size, "node_id", "left").filter(F.col("n") / F.greatest(F.coalesce("size", F.lit(0)), F.lit(1)) >= self.thresholds.beta)
        return materialise(ok.select("hkt_id", "node_id", "token"), "drift-assigned")

    @functools.cached_property
    def word_change(self) -> DataFrame:
        """One row per HKT and word, with before, new, after, strength, eligibility and importance in both states.

        A word that several nodes hold is reported for the one with the highest id; an expected word
        that no node takes has node_id 0.
        """
        t = self.thresholds
        s0 = self.state.word_sources.join(self.nodes.filter("NOT refuge").select("node_id", "hkt_id"), "node_id").select("hkt_id", "node_id", "token", "source")
        n0, n1 = self.counts(s0, "n0"), self.counts(self.hits, "n1")
        none = lambda c: F.coalesce(F.col(c), F.lit(0))
        own = self.words.select("hkt_id", "node_id", "ord", "token", "word_id").join(n0, ["node_id", "token"], "left").join(n1, ["node_id", "token"], "left").withColumn("n0", none("n0")).withColumn("n1", none("n1"))
        lead_n = self.lead.join(n0, ["node_id", "token"], "left").select("hkt_id", none("n0").alias("lead_n"))
        sums = own.groupBy("hkt_id").agg(F.sum("n0").alias("a0"), F.sum(F.col("n0") + F.col("n1")).alias("a1"), F.max(F.col("n0") + F.col("n1")).alias("m"))
        wanted = self.expected.groupBy("hkt_id").agg(F.sum("total").alias("e"), F.max("total").alias("em"))
        per = self.hkts.select("hkt_id").join(sums, "hkt_id", "left").join(wanted, "hkt_id", "left").join(lead_n, "hkt_id", "left").select(
            "hkt_id", F.greatest(none("a0"), F.lit(1)).alias("all0"), F.greatest(none("a1") + none("e"), F.lit(1)).alias("all1"),
            F.greatest(none("lead_n"), F.lit(1)).alias("p0"), F.greatest(none("m"), none("em"), F.lit(1)).alias("p1"),
        )
        held = self.words.select("hkt_id", "node_id", "token").unionByName(self.assigned.select("hkt_id", "node_id", "token")).distinct()
        after = s0.select("node_id", "token", "source", F.lit(0).alias("new")).unionByName(self.fresh.select("node_id", "token", "source", F.lit(1).alias("new")))
        each = after.groupBy("node_id", "token", "source").agg(F.min("new").alias("new"))
        inside = self.state.node_sources.join(self.nodes.select("node_id"), "node_id", "left_semi").select("node_id", "source").unionByName(self.routed.select("node_id", "source")).distinct()
        prom = s0.join(self.lead_words.select("node_id", "token"), ["node_id", "token"]).select("node_id", "source")
        flags = each.join(inside.withColumn("i", F.lit(1)), ["node_id", "source"], "left").join(prom.withColumn("p", F.lit(1)), ["node_id", "source"], "left")
        by_word = flags.groupBy("node_id", "token").agg(F.count_if(F.col("new") == 0).alias("before"), F.count(F.lit(1)).alias("after"), F.count("i").alias("common1"), F.count_if((F.col("new") == 0) & F.col("p").isNotNull()).alias("common0"))
        size1 = inside.groupBy("node_id").agg(F.count(F.lit(1)).alias("size1"))
        size0 = prom.groupBy("node_id").agg(F.count(F.lit(1)).alias("size0"))
        rows = held.join(by_word, ["node_id", "token"], "left").join(size0, "node_id", "left").join(size1, "node_id", "left").select(
            "hkt_id", "node_id", "token", none("before").alias("before"), (none("after") - none("before")).alias("new"), none("after").alias("after"),
            (none("common0") / F.greatest(none("size0"), F.lit(1))).alias("eligibility0"), (none("common1") / F.greatest(none("size1"), F.lit(1))).alias("eligibility1"),
        )
        one = rows.withColumn("r", F.row_number().over(Window.partitionBy("hkt_id", "token").orderBy(F.desc("node_id")))).filter("r = 1").drop("r")
        loose = self.expected.join(held, ["hkt_id", "token"], "left_anti").join(self.scope_df, ["hkt_id", "token"], "left")
        zero = F.lit(0).cast("long")
        loose = loose.select("hkt_id", F.lit(0).alias("node_id"), "token", zero.alias("before"), none("df1").alias("new"), F.col("total").alias("after"), F.lit(0.0).alias("eligibility0"), F.lit(0.0).alias("eligibility1"))
        full = one.unionByName(loose).join(per, "hkt_id").withColumns(
            {"strength0": F.col("before") / F.col("p0"), "strength1": F.col("after") / F.col("p1"), "importance0": F.col("before") / F.col("all0"), "importance1": F.col("after") / F.col("all1")}
        )
        in_node = F.col("node_id") != 0
        gap = lambda level, c: F.when(in_node | F.lit(c.startswith("strength")), F.lit(level) - F.col(c)).otherwise(F.lit(0.0))
        full = full.withColumns({"alpha_gap0": gap(t.alpha, "strength0"), "alpha_gap1": gap(t.alpha, "strength1"), "beta_gap0": gap(t.beta, "eligibility0"), "beta_gap1": gap(t.beta, "eligibility1")})
        full = full.withColumns({"alpha_error": F.greatest("alpha_gap1", F.lit(0.0)), "beta_error": F.greatest("beta_gap1", F.lit(0.0))})
        names = ["hkt_id", "token", "node_id", "before", "new", "after", "strength0", "strength1", "eligibility0", "eligibility1", "importance0", "importance1", "alpha_gap0", "alpha_gap1", "beta_gap0", "beta_gap1", "alpha_error", "beta_error"]
        return materialise(full.select(*names), "drift-change")

    @functools.cached_property
    def errors(self) -> DataFrame:
        """hkt_id, n, alpha_value, beta_value, retained, alpha1 to alpha3, beta1 to beta3, wi1, wi2.

        Sums are of decimals with 24 places, so that they don't depend on the order of rows.
        """
        t = self.thresholds
        exact = lambda c: F.coalesce(F.sum(c.cast("decimal(38,24)")), F.lit(0)).cast("double")
        low = lambda c, level: F.greatest(F.lit(level) - F.col(c), F.lit(0.0))
        moved = lambda a, b, level: F.when(F.col(b) < level, F.abs(F.col(b) - F.col(a))).otherwise(0.0)
        square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
        sums = {
            "s": F.col("strength1"), "e": F.col("eligibility1"), "retained": F.col("importance1"),
            "a1": low("strength1", t.alpha), "a2": moved("strength0", "strength1", t.alpha), "a3": square("strength0", "strength1"),
            "b1": low("eligibility1", t.beta), "b2": moved("eligibility0", "eligibility1", t.beta), "b3": square("eligibility0", "eligibility1"), "w2": square("importance0", "importance1"),
        }
        rows = self.word_change.filter("node_id <> 0").groupBy("hkt_id").agg(F.count(F.lit(1)).cast("int").alias("n"), *[exact(c).alias(k) for k, c in sums.items()])
        every = self.hkts.select("hkt_id").join(rows, "hkt_id", "left").fillna(0)
        mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
        r4 = lambda c: round_half_away(c, 4)
        return every.select(
            "hkt_id", "n", mean("s").alias("alpha_value"), mean("e").alias("beta_value"), "retained", r4(mean("a1")).alias("alpha1"), r4(mean("a2")).alias("alpha2"), r4(F.sqrt("a3")).alias("alpha3"),
            r4(mean("b1")).alias("beta1"), r4(mean("b2")).alias("beta2"), r4(F.sqrt("b3")).alias("beta3"), r4(1 - F.col("retained")).alias("wi1"), r4(F.sqrt("w2")).alias("wi2"),
        )

    @functools.cached_property
    def scope_sizes(self) -> DataFrame:
        """hkt_id, scoped_sources, matched_nodes, known_words, new_words."""
        sources = self.frontier.groupBy("hkt_id").agg(F.count(F.lit(1)).alias("scoped_sources"))
        matched = self.routed.groupBy("hkt_id").agg(F.count_distinct("node_id").alias("matched_nodes"))
        known = self.known if self.known is not None else self.state.node_words.select("token").distinct()
        words = self.scope_df.join(known.withColumn("k", F.lit(1)), "token", "left").groupBy("hkt_id").agg(F.count("k").alias("known_words"), F.count_if(F.col("k").isNull()).alias("new_words"))
        zero = {"matched_nodes": 0, "known_words": 0, "new_words": 0}
        return sources.join(matched, "hkt_id", "left").join(words, "hkt_id", "left").fillna(zero)

    @functools.cached_property
    def inputs(self) -> DataFrame:
        """One row per HKT of what its figures are made from: the vocabulary that the batch retains, and how strongly.

        mass is the share of all word occurrences (sources by word) that fall on the HKT's own words.
        """
        own = self.word_change.filter("node_id <> 0").select("hkt_id", "token", "after", "strength1")
        seen = own.join(self.scope_df, ["hkt_id", "token"], "left").groupBy("hkt_id").agg(
            F.count(F.lit(1)).alias("state0_words"), F.count("df1").alias("retained_words"), F.coalesce(F.sum("df1"), F.lit(0)).alias("held"), F.max("after").alias("prominent_df"),
            F.count_if(F.col("strength1") < self.thresholds.alpha).alias("alpha_violations"),
        )
        total = self.scope_df.groupBy("hkt_id").agg(F.sum("df1").alias("total_df"))
        rows = self.scope_sizes.join(seen, "hkt_id", "left").join(total, "hkt_id", "left").fillna(0)
        share = lambda a, b: F.when(b > 0, F.least(a / b, F.lit(1.0))).otherwise(0.0)
        words = F.col("known_words") + F.col("new_words")
        return rows.select(
            "hkt_id", "state0_words", "known_words", "new_words", "retained_words", "total_df", share(F.col("held"), F.col("total_df")).alias("mass"), share(F.col("retained_words"), F.col("state0_words")).alias("retained_ratio"),
            share(F.col("known_words"), words).alias("known_ratio"), share(F.col("new_words"), words).alias("new_ratio"), "prominent_df", "alpha_violations",
        )

    @functools.cached_property
    def node_vocabulary(self) -> DataFrame:
        """hkt_id, node_id, state0_words (a refuge has its marker), known_words, new_words, share of new words in what is routed to the node."""
        known = self.known if self.known is not None else self.state.node_words.select("token").distinct()
        seen = self.node_df.join(known.withColumn("k", F.lit(1)), "token", "left").groupBy("node_id").agg(F.count("k").alias("known_words"), F.count_if(F.col("k").isNull()).alias("new_words"))
        own = self.words.groupBy("node_id").agg(F.count(F.lit(1)).alias("w"))
        rows = self.nodes.select("hkt_id", "node_id", "refuge").join(own, "node_id", "left").join(seen, "node_id", "left").fillna(0, ["known_words", "new_words"])
        words = F.col("known_words") + F.col("new_words")
        return rows.select("hkt_id", "node_id", F.when(F.col("refuge"), 1).otherwise(F.coalesce("w", F.lit(0))).cast("long").alias("state0_words"), "known_words", "new_words", F.when(words > 0, F.col("new_words") / words).otherwise(0.0).alias("share"))

    @functools.cached_property
    def plain_beta(self) -> DataFrame:
        """hkt_id, beta_error: the mean over all nodes' words of how far the share of the node's routed sources that hold the word stays under beta.

        A refuge counts as one word that no source holds.
        """
        size = self.routed.groupBy("node_id").agg(F.count(F.lit(1)).alias("size"))
        words = self.words.select("hkt_id", "node_id", "token").unionByName(self.nodes.filter("refuge").select("hkt_id", "node_id", F.lit(None).cast("string").alias("token")))
        rows = words.join(self.node_df.select("node_id", "token", "df1"), ["node_id", "token"], "left").join(size, "node_id", "left")
        share = F.when(F.col("size") > 0, F.coalesce("df1", F.lit(0)) / F.col("size")).otherwise(0.0)
        gap = F.greatest(F.lit(self.thresholds.beta) - share, F.lit(0.0))
        mean = rows.groupBy("hkt_id").agg(F.least(F.avg(gap), F.lit(1.0)).alias("e"))
        return self.hkts.select("hkt_id").join(mean, "hkt_id", "left").select("hkt_id", F.coalesce("e", F.lit(0.0)).alias("beta_error"))

    @functools.cached_property
    def expected_inputs(self) -> DataFrame:
        """An older form of ``inputs``, made from the expected words instead of the nodes' words, with the figures that follow from it.

        hkt_id, expected_words, retained_words, total_df, mass, prominent_df (the largest df among
        expected and node words), alpha_violations, alpha_value (share of expected words that the
        batch retains), beta_value (mean share of new words over nodes that the batch reaches),
        alpha_error, beta_error, wi_error. Strength is df over prominent_df. Words that the
        vocabulary lacks count as absent.
        """
        known = self.known if self.known is not None else self.state.node_words.select("token").distinct()
        seen = self.scope_df.join(known, "token", "left_semi")
        rows = self.expected.select("hkt_id", "token").join(seen, ["hkt_id", "token"], "left")
        named = self.expected.select("hkt_id", "token").unionByName(self.words.select("hkt_id", "token")).distinct()
        most = named.join(seen, ["hkt_id", "token"]).groupBy("hkt_id").agg(F.max("df1").alias("prominent_df"))
        total = self.scope_df.groupBy("hkt_id").agg(F.sum("df1").alias("total_df"))
        strength = F.when(F.col("prominent_df") > 0, F.least(F.coalesce("df1", F.lit(0)) / F.col("prominent_df"), F.lit(1.0))).otherwise(0.0)
        low = F.greatest(F.lit(self.thresholds.alpha) - F.col("strength"), F.lit(0.0))
        made = rows.join(most, "hkt_id", "left").withColumn("strength", strength).groupBy("hkt_id").agg(
            F.count(F.lit(1)).alias("expected_words"), F.count("df1").alias("retained_words"), F.coalesce(F.sum("df1"), F.lit(0)).alias("held"),
            F.count_if(F.col("strength") < self.thresholds.alpha).alias("alpha_violations"), F.least(F.avg(low), F.lit(1.0)).alias("alpha_error"),
        )
        active = self.node_vocabulary.filter(F.col("known_words") + F.col("new_words") > 0).groupBy("hkt_id").agg(F.avg("share").alias("beta_value"))
        every = self.hkts.select("hkt_id").join(made, "hkt_id", "left").join(most, "hkt_id", "left").join(total, "hkt_id", "left").join(active, "hkt_id", "left").join(self.plain_beta, "hkt_id", "left").fillna(0)
        share = lambda a, b: F.when(F.col(b) > 0, F.least(F.col(a) / F.col(b), F.lit(1.0))).otherwise(0.0)
        mass = share("held", "total_df")
        return every.select(
            "hkt_id", "expected_words", "retained_words", "total_df", mass.alias("mass"), "prominent_df", "alpha_violations", share("retained_words", "expected_words").alias("alpha_value"), "beta_value",
            "alpha_error", "beta_error", (F.lit(1.0) - mass).alias("wi_error"),
        )

    def shadow(self, policy: str) -> DataFrame:
        """hkt_id, shadow_reasons: what the gates of the paper's policy would say, comma-joined; under ``Placeholder`` from the older figures. It decides nothing."""
        if policy != "Placeholder":
            return self.decisions(policy).select("hkt_id", F.col("reasons").alias("shadow_reasons"))
        t = self.thresholds
        a, b, w = (int(x[-1]) for x in (t.selected_alpha_option, t.selected_beta_option, t.selected_word_importance_option))
        rows = self.expected_inputs.join(self.errors.select("hkt_id", "n"), "hkt_id").join(self.scope_sizes.select("hkt_id", "scoped_sources"), "hkt_id")
        alpha = round_half_away(F.lit(t.alpha_option3_threshold) * F.sqrt(F.col("n").cast("double")), 3) if a == 3 else F.lit(getattr(t, f"alpha_option{a}_threshold"))
        limits = (("word_importance", "wi_error", F.lit(getattr(t, f"word_importance_option{w}_threshold"))), ("alpha", "alpha_error", alpha), ("beta", "beta_error", F.lit(getattr(t, f"beta_option{b}_threshold"))))
        over = F.array_compact(F.array(*[F.when(F.col(c) > limit, F.lit(name)) for name, c, limit in limits]))
        tiny = F.when((F.size(over) > 0) & (F.col("scoped_sources") <= 1), F.array_append(over, F.lit("tiny"))).otherwise(over)
        return rows.select("hkt_id", F.array_join(tiny, ",").alias("shadow_reasons"))

    def notes(self, policy: str) -> DataFrame:
        """hkt_id, line, text: what there is to say of each HKT, in order of line."""
        paper = policy != "Placeholder"
        four = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
        word = lambda *parts: F.concat(F.lit("HKT "), F.col("hkt_id"), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
        made = self.decisions(policy)
        figures = self.inputs if paper else self.expected_inputs.withColumnRenamed("expected_words", "state0_words")
        taken = self.expected.groupBy("hkt_id").agg(F.count(F.lit(1)).alias("expected_now"))
        above = self.accepted.groupBy("hkt_id").agg(F.count(F.lit(1)).alias("above"))
        rows = made.join(self.scope_sizes.drop("scoped_sources"), "hkt_id").join(figures.drop("known_words", "new_words", "alpha_error", "beta_error", "wi_error"), "hkt_id").join(self.shadow(policy), "hkt_id")
        rows = rows.join(taken, "hkt_id", "left").join(above, "hkt_id", "left").fillna(0, ["expected_now", "above"])
        lines = [
            word(": scoped sources=", F.col("scoped_sources"), ", matched nodes=", F.col("matched_nodes"), ", known words=", F.col("known_words"), ", new words=", F.col("new_words")),
            F.when(F.col("expected_now") > 0, word(" update: expected words=", F.col("expected_now"))),
            word(" errors: word_importance=", four("wi_error"), ", alpha=", four("alpha_error"), ", beta=", four("beta_error")),
            word(f" policy: {policy}"),
            word(" words accepted above: ", F.col("above")),
            word(" figures: words=", F.col("state0_words"), ", retained=", F.col("retained_words"), ", total_df=", F.col("total_df"), ", mass=", four("mass"), ", prominent_df=", F.col("prominent_df"), ", below alpha=", F.col("alpha_violations")),
            word(" shadow: would trigger=", (F.col("shadow_reasons") != "").cast("string")),
            F.when(F.col("shadow_reasons") != "", word(" shadow reasons: ", F.col("shadow_reasons"))),
            F.when(F.col("triggered"), word(" trigger reasons: ", F.col("reasons"))),
        ]
        own = rows.select("hkt_id", F.posexplode(F.array(*lines)).alias("line", "text")).filter("text IS NOT NULL")
        node = F.concat(F.lit("HKT "), "hkt_id", F.lit(" node "), "node_id", F.lit(": beta="), four("share"), F.lit(" (own words="), "state0_words", F.lit(", known="), "known_words", F.lit(", new="), "new_words", F.lit(")"))
        nodes = self.node_vocabulary.select("hkt_id", (F.lit(len(lines)) + F.col("node_id")).alias("line"), node.alias("text"))
        return own.unionByName(nodes)

    def decisions(self, policy: str) -> DataFrame:
        """hkt_id, errors and thresholds in use, reasons (comma-joined) and triggered."""
        t = self.thresholds
        if policy == "Placeholder":
            words = F.col("known_words") + F.col("new_words")
            share = lambda c: F.when(words > 0, F.col(c) / words).otherwise(0.0)
            rows = self.scope_sizes.select(
                "hkt_id", "scoped_sources", F.abs(share("known_words") - t.alpha).alias("alpha_error"), F.abs(share("new_words") - t.beta).alias("beta_error"), share("new_words").alias("wi_error"),
                F.lit(t.alpha_error_threshold).alias("alpha_threshold"), F.lit(t.beta_error_threshold).alias("beta_threshold"), F.lit(t.word_importance_error_threshold).alias("wi_threshold"),
            )
            gates = ["wi"]
        else:
            a, b, w = (int(x[-1]) for x in (t.selected_alpha_option, t.selected_beta_option, t.selected_word_importance_option))
            alpha = round_half_away(F.lit(t.alpha_option3_threshold) * F.sqrt(F.col("n").cast("double")), 3) if a == 3 else F.lit(getattr(t, f"alpha_option{a}_threshold"))
            rows = self.errors.join(self.scope_sizes.select("hkt_id", "scoped_sources"), "hkt_id").select(
                "hkt_id", "scoped_sources", F.col(f"alpha{a}").alias("alpha_error"), F.col(f"beta{b}").alias("beta_error"), F.col(f"wi{w}").alias("wi_error"), alpha.alias("alpha_threshold"),
                F.lit(getattr(t, f"beta_option{b}_threshold")).alias("beta_threshold"), F.lit(getattr(t, f"word_importance_option{w}_threshold")).alias("wi_threshold"),
            )
            gates = ["wi", "alpha", "beta"]
        over = F.array_compact(F.array(*[F.when(F.col(f"{g}_error") > F.col(f"{g}_threshold"), F.lit({"wi": "word_importance"}.get(g, g))) for g in gates]))
        tiny = F.when((F.size(over) > 0) & (F.col("scoped_sources") <= 1), F.array_append(over, F.lit("tiny"))).otherwise(over)
        return materialise(rows.withColumn("reasons", F.array_join(tiny, ",")).withColumn("triggered", F.col("reasons") != ""), "drift-decisions")

    def staged(self, hkts: DataFrame) -> DataFrame:
        """node_id, token, source to fold into the nodes of ``hkts``: state-1 sources of their own and assigned words."""
        return self.fresh.join(hkts.select("hkt_id"), "hkt_id", "left_semi").select("node_id", "token", "source")

    def below(self, hkts: DataFrame) -> Level | None:
        """The level under ``hkts``: their nodes' child HKTs with the sources routed to them."""
        child = self.state.hkts.select(F.col("hkt_id").alias("child"), F.col("parent_node_id").alias("node_id"))
        placed = self.nodes.join(hkts.select("hkt_id"), "hkt_id").select("hkt_id", "node_id").join(child, "node_id")
        frontier = materialise(self.routed.select("node_id", "source").join(placed, "node_id").select(F.col("child").alias("hkt_id"), "source"), "drift-frontier")
        if not frontier.limit(1).count():
            return None
        above = placed.select("hkt_id", "child").join(self.accepted, "hkt_id").select(F.col("child").alias("hkt_id"), "token")
        own = self.words.select("node_id", "token").unionByName(self.assigned.select("node_id", "token")).join(placed, "node_id").select(F.col("child").alias("hkt_id"), "token")
        return replace(self, frontier=frontier, accepted=materialise(above.unionByName(own).distinct(), "drift-accepted"))


def root_level(state: State, sources: DataFrame, tokens: DataFrame, first: DataFrame, thresholds: ThresholdConfig, known: DataFrame | None = None, first_df: DataFrame | None = None) -> Level:
    """The root HKT (the lowest one without a parent) with all ``sources`` (source) of the batch."""
    root = state.hkts.filter("parent_node_id = 0").orderBy("hkt_id").limit(1).select("hkt_id")
    frontier = sources.select("source").distinct().crossJoin(F.broadcast(root)).select("hkt_id", "source")  # one row
    none = frontier.select("hkt_id", F.lit("").alias("token")).limit(0)
    return Level(state, frontier, tokens, first, none, thresholds, known, first_df)


def plan(level: Level, policy: str) -> tuple[DataFrame | None, list[Level], list[DataFrame]]:
    """(decisions of all HKTs reached, levels, their HKTs that aren't triggered). Nothing below a triggered HKT is reached."""
    levels, accepted, every = [], [], None
    while level is not None:
        made = level.decisions(policy)
        every = made if every is None else every.unionByName(made)
        calm = made.filter("NOT triggered").select("hkt_id")
        levels.append(level)
        accepted.append(calm)
        level = level.below(calm)
    return every, levels, accepted


def merged(state: State, levels: list[Level], accepted: list[DataFrame]) -> State:
    """The state after folding the batch into the HKTs that accept it."""
    word_sources, expected = state.word_sources, state.expected
    staged = None
    for level, calm in zip(levels, accepted, strict=True):
        more = level.staged(calm)
        staged = more if staged is None else staged.unionByName(more)
        new = level.expected.join(calm, "hkt_id").select("hkt_id", "token")
        expected = expected.join(calm, "hkt_id", "left_anti").unionByName(new)
    if staged is None:
        return state
    staged = materialise(staged.distinct(), "drift-staged")
    return replace(
        state,
        word_sources=grown(word_sources, _missing(staged, word_sources), "state-word_sources"),
        node_sources=grown(state.node_sources, _missing(staged.select("node_id", "source").distinct(), state.node_sources), "state-node_sources"),
        expected=materialise(expected, "state-expected"),
    )


def _missing(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The ``rows`` that ``held`` lacks; only what it has of their sources is compared."""
    near = held.join(rows.select("source").distinct(), "source", "left_semi")
    return rows.join(near, rows.columns, "left_anti")
