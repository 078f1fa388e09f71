"""What a step costs: jobs, tables and expressions that a query must not come back to. Results are compared elsewhere, by SQL."""

import re

from pyspark.sql import functions as F

from driftgrove import engine
from driftgrove.engine import Engine
from driftgrove.functions.text import STOP_WORDS, trim, words
from driftgrove.plans import workload

ODD = ["", " ", "a", "A_b9  C", "Kİ x\x00y", "--", "the the End.", "x" * 3000, "été 1,2", "z\n", None]


def test_words_are_matched_not_split(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string").select("i", words(F.col("t")).alias("all"), words(F.col("t"), STOP_WORDS).alias("few"))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows.collect():
        all_ = re.findall("[a-z0-9_]+", (ODD[r["i"]] or "").translate(low))
        assert (r["all"], r["few"]) == (all_, [w for w in all_ if w not in STOP_WORDS])
    assert "split(" not in rows._jdf.queryExecution().analyzed().toString()


def test_registry_of_clean_sources_trims_no_token(spark, make_sources, monkeypatch):
    calls = []
    monkeypatch.setattr(engine, "trim", lambda c: calls.append(c) or trim(c))
    rows = make_sources({"a": "x y x", "b": "", "c": "z"})
    own, plain = Engine(spark), Engine(spark)
    got = {r["source_id"]: (r["source"], r["tokens"]) for r in own.register(rows, 0, clean=True).collect()}
    assert not calls
    assert got == {r["source_id"]: (r["source"], r["tokens"]) for r in plain.register(rows, 0).collect()} and calls


def test_batch_that_rebuilds_all_is_neither_merged_nor_pruned(spark, make_sources, monkeypatch):
    def refuse(*_):
        raise AssertionError("the old tree goes anyway")

    monkeypatch.setattr(engine.drift, "merged", refuse)
    monkeypatch.setattr(engine.prune, "light", refuse)
    e = Engine(spark, workload.always(memory_mode="SlidingWindow", max_batches_in_memory=1))
    e.build_baseline(make_sources({"a": "x y", "b": "x z"}), 0)
    result = e.process_batch(make_sources({"b": "x q", "c": "q r"}), 1)
    assert result.reconstruction_triggered and result.notes[-1] == "Pruning: active sources=2, pruned sources=0, nodes=0, HKTs=0"
    assert {r["source_id"] for r in e.registry.collect()} == {"b", "c"}
    held = {r["source"] for r in e.state.node_sources.collect()}
    assert held == {r["source"] for r in e.registry.collect()} == {r["source"] for r in e.members[1].collect()}
