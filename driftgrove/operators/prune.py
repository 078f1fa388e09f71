"""Subtrees, ancestors and the pruning of what a sliding window leaves behind."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrove.operators.drift import State
from driftgrove.tables import materialise


def subtree(hkts: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """hkt_id of ``roots`` and of all HKTs below them, a join per level."""
    edges = materialise(hkts.select(F.col("hkt_id").alias("child"), F.col("parent_node_id").alias("node_id")).join(nodes.select("node_id", F.col("hkt_id").alias("parent")), "node_id").select("parent", "child"), "prune-edges")
    found = front = materialise(roots.select(F.col("hkt_id").cast("int").alias("hkt_id")).distinct(), "prune-found")
    while True:
        below = edges.join(front, edges["parent"] == front["hkt_id"]).select(F.col("child").alias("hkt_id")).distinct()
        front = materialise(below.join(found, "hkt_id", "left_anti"), "prune-front")
        if not front.limit(1).count():
            return found
        found = materialise(found.unionByName(front), "prune-found")


def chains(hkts: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """hkt_id, node_id: all nodes above each HKT of ``starts``, a join per level for all of them together."""
    up = hkts.select(F.col("hkt_id").alias("at"), F.col("parent_node_id").alias("node_id")).join(nodes.select("node_id", F.col("hkt_id").alias("above")), "node_id")
    found = front = materialise(starts.select("hkt_id", F.lit(0).alias("node_id"), F.col("hkt_id").alias("at")).distinct(), "prune-chains")
    while True:
        step = front.select("hkt_id", "at").join(up, "at").select("hkt_id", "node_id", F.col("above").alias("at"))
        front = materialise(step.join(found.select("hkt_id", "node_id"), ["hkt_id", "node_id"], "left_anti"), "prune-chains")
        if front.isEmpty():
            return found.filter("node_id > 0").select("hkt_id", "node_id")
        found = found.unionByName(front)


def ancestors(hkts: DataFrame, nodes: DataFrame, node_id: int) -> DataFrame:
    """node_id and the nodes above it up to the root."""
    own = hkts.sparkSession.createDataFrame([(node_id,)], "node_id int")
    return own.unionByName(chains(hkts, nodes, nodes.filter(F.col("node_id") == node_id).select("hkt_id")).select("node_id")).distinct()


def light(state: State, active: DataFrame) -> tuple[State, dict]:
    """(state without sources that aren't ``active``, what went).

    A node dies when none of its words, or for a refuge none of its sources, is left; an HKT dies
    with its last node and takes all below it along, and so does a dead node's child HKT. If every
    HKT would die, the structure stays.
    """
    node_sources = materialise(state.node_sources.join(active, "source", "left_semi").select("node_id", "source"), "state-node_sources")
    word_sources = materialise(state.word_sources.join(active, "source", "left_semi").select("node_id", "token", "source"), "state-word_sources")
    alive = word_sources.select("node_id").unionByName(state.nodes.filter("refuge").join(node_sources, "node_id").select("node_id")).distinct()
    dead = materialise(state.nodes.join(alive, "node_id", "left_anti").select("node_id", "hkt_id"), "prune-dead")
    left = state.nodes.join(dead.select("node_id"), "node_id", "left_anti").select("hkt_id").distinct()
    roots = state.hkts.join(left, "hkt_id", "left_anti").select("hkt_id")
    under = state.hkts.join(dead.select(F.col("node_id").alias("parent_node_id")), "parent_node_id").select("hkt_id")
    gone = subtree(state.hkts, state.nodes, roots.unionByName(under))
    n, total = gone.count(), state.hkts.count()
    if n == total and n:
        return replace(state, node_sources=node_sources, word_sources=word_sources), {"nodes": 0, "hkts": 0}
    dead_nodes = materialise(dead.select("node_id").unionByName(state.nodes.join(gone, "hkt_id").select("node_id")).distinct(), "prune-nodes")
    keep = lambda df: df.join(dead_nodes, "node_id", "left_anti").select(df.columns)
    out = State(
        state.hkts.join(gone, "hkt_id", "left_anti").select(state.hkts.columns), keep(state.nodes), keep(state.node_words), keep(node_sources), keep(word_sources),
        state.expected.join(gone, "hkt_id", "left_anti").select(state.expected.columns),
    )
    return out.kept(), {"nodes": dead_nodes.count(), "hkts": n}
