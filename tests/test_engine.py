import pytest
from pyspark.sql import functions as F

from driftgrove.config import BuilderConfig, Config, ThresholdConfig
from driftgrove.engine import Engine
from driftgrove.errors import InvalidConfiguration, StateError
from driftgrove.operators import prune

QUAKE = [
    {"s1": "earthquake damage city", "s2": "earthquake rescue city", "s3": "storm damage coast"},
    {"s4": "earthquake aftershock city", "s5": "rescue teams deployed"},
    {"s6": "storm coast warning", "s7": "power outage city"},
]
NOVEL = {"s4": "volcano ash plume", "s5": "evacuation zone ash"}
OPTIONS = [f"{n}_option{i}_threshold" for n, k in (("alpha", 3), ("beta", 3), ("word_importance", 2)) for i in range(1, k + 1)]


def never(**more):
    return Config(thresholds=ThresholdConfig(alpha=1.0, beta=0.0, **dict.fromkeys(OPTIONS, 1.0)), **more)


def always(**more):
    return Config(thresholds=ThresholdConfig(alpha=0.0, beta=0.0, **dict.fromkeys(OPTIONS, 0.0)), **more)


def flat(e):
    doc = e.tree().verbose()
    nodes = {(n["node_id"], n["hkt_id"], n["is_refuge_node"], tuple(w["token"] for w in n["words"]), tuple(sorted(s["external_source_id"] for s in n["sources"]))) for n in doc["nodes"]}
    hkts = {(h["hkt_id"], h["parent_node_id"], tuple(h["node_ids"]), tuple(w["token"] for w in h["expected_words"])) for h in doc["hkts"]}
    return nodes, hkts


def invariants(e):
    nodes, hkts = flat(e)
    ids = {n[0] for n in nodes}
    assert nodes and hkts and len(ids) == len(nodes) and len({h[0] for h in hkts}) == len(hkts)
    assert any(h[1] == 0 for h in hkts) and all(h[1] == 0 or h[1] in ids for h in hkts)
    assert all(h[2] for h in hkts) and all(n[3] and n[4] for n in nodes)
    owner = {n[0]: n[1] for n in nodes}
    assert all(owner[i] == h[0] for h in hkts for i in h[2])


def test_sequence(spark, make_sources):
    e = Engine(spark)
    with pytest.raises(StateError, match="not been built"):
        e.process_batch(make_sources(QUAKE[1]), 1)
    with pytest.raises(StateError):
        e.build_baseline(make_sources({}) if False else make_sources(QUAKE[0]).limit(0))
    e.build_baseline(make_sources(QUAKE[0]))
    with pytest.raises(StateError, match="out of sequence; expected 1"):
        e.process_batch(make_sources(QUAKE[1]), 2)
    with pytest.raises(StateError, match="must be greater"):
        e.process_batch(make_sources(QUAKE[1]), 0)
    assert e.explain_last_update().reason_codes == ["BASELINE_INITIALIZED", "HKT_BUILDER_PHASE1"]


def test_merge_without_rebuild_and_restore(spark, make_sources, tmp_path):
    e = Engine(spark, never())
    e.build_baseline(make_sources(QUAKE[0]))
    before = flat(e)
    r = e.process_batch(make_sources(QUAKE[1]), 1)
    assert not r.reconstruction_triggered and flat(e) != before
    assert "RECONSTRUCTION_SKIPPED" in e.explain_last_update().reason_codes
    invariants(e)
    path = f"file://{tmp_path}/saved"
    e.save(path)
    again = Engine.load(spark, path)
    assert flat(again) == flat(e)
    a, b = e.process_batch(make_sources(QUAKE[2]), 2), again.process_batch(make_sources(QUAKE[2]), 2)
    assert a == b and flat(again) == flat(e)
    bare = Engine.from_snapshot(spark, e.snapshot())
    assert bare.snapshot() == e.snapshot()
    with pytest.raises(StateError, match="not been built"):
        bare.process_batch(make_sources(QUAKE[2]), 3)


def test_full_rebuild_equals_a_fresh_baseline(spark, make_sources):
    e = Engine(spark, always())
    e.build_baseline(make_sources(QUAKE[0]))
    r = e.process_batch(make_sources(NOVEL), 1)
    assert r.reconstruction_triggered and "FULL_REBUILD_EXECUTED" in e.explain_last_update().reason_codes
    assert {r["token"] for r in e.vocabulary.collect()} >= {"volcano", "ash"}
    fresh = Engine(spark, always())
    fresh.build_baseline(make_sources(QUAKE[0] | NOVEL))
    assert flat(e) == flat(fresh)
    invariants(e)


@pytest.mark.parametrize("mode", ["hybrid", "subtree"])
def test_rebuild_modes(spark, make_sources, mode):
    e = Engine(spark, always(), mode)
    e.build_baseline(make_sources(QUAKE[0]))
    old = {h[0] for h in flat(e)[1]}, {n[0] for n in flat(e)[0]}
    assert e.process_batch(make_sources(QUAKE[1]), 1).reconstruction_triggered
    if mode == "subtree":
        nodes, hkts = flat(e)
        assert min(h[0] for h in hkts) > max(old[0]) and min(n[0] for n in nodes) > max(old[1])
        assert e.tree().plain()["logically_removed_hkts"]
    else:
        assert "HYBRID_REBUILD_FALLBACK_EXECUTED" in e.explain_last_update().reason_codes
    invariants(e)


def test_window(spark, make_sources):
    config = never(memory_mode="SlidingWindow", max_batches_in_memory=2)
    e = Engine(spark, config)
    e.build_baseline(make_sources({"s0": "a"}))
    counts = [e.stored_batch_count]
    for i, t in enumerate(({"s1": "b"}, {"s2": "c"}), 1):
        e.process_batch(make_sources(t), i)
        counts.append(e.stored_batch_count)
    assert counts == [1, 2, 2]
    assert "s0" not in {r["source_id"] for r in e.registry.collect()}
    assert "WINDOW_PRUNING_APPLIED" in e.explain_last_update().reason_codes
    with pytest.raises(InvalidConfiguration):
        Config(memory_mode="SlidingWindow", max_batches_in_memory=0).window


def test_rebuild_scope(spark, make_sources):
    e = Engine(spark)
    e.build_baseline(make_sources({"s1": "a b c", "s2": "a b", "s3": "a d"}))
    held = e.register(make_sources({"s4": "a e f"}, 1), 1)
    e.batches[1] = held
    rows = e.rebuild_scope(1, held.select("source"), spark.createDataFrame([("b",)], "token string"))
    df = {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert df == {"a": 4, "c": 1, "d": 1, "e": 1, "f": 1}


def test_dry_run_and_given_hkts(spark, make_sources):
    e = Engine(spark, never(), "subtree")
    assert e.detect_clusters()["cluster_count"] == 0
    e.build_baseline(make_sources(QUAKE[0]))
    assert e.detect_clusters()["cluster_count"] == 5
    e.process_batch(make_sources(QUAKE[1]), 1)
    before = flat(e)
    none = spark.createDataFrame([], "token string")
    scoped = e.batches[1].select("source")
    report = e.dry_run(1, scoped, none)
    assert report["scoped_source_count"] == 5 and report["subtree_hkt_count"] >= 1 and report["subtree_node_count"] >= report["subtree_hkt_count"]
    assert report["new_token_count_in_scope"] == 3 and flat(e) == before
    assert e.rebuild_hkts([1], make_sources(QUAKE[1])) == "SELECTED_REBUILD_EXECUTED"
    nodes, hkts = flat(e)
    assert (len(hkts), len(nodes)) == (report["subtree_hkt_count"], report["subtree_node_count"])
    invariants(e)
    with pytest.raises(StateError, match="reaches no HKT"):
        e.rebuild_hkts([999], make_sources(QUAKE[1]))


def test_branches_are_rebuilt_together(spark, make_sources):
    """A forest of several branches equals their rebuilds one after the other; a branch below another goes with it."""
    texts = {f"s{i}": t for i, t in enumerate(["a b c x", "a b d", "a c d y", "a d", "e f g", "e f h z", "e g h", "e h b", "a e f", "c d f"])}
    states, targets = [], []
    for together in (True, False):
        e = Engine(spark, never(builder=BuilderConfig(0.3, 0.6, 1)), "subtree")
        e.build_baseline(make_sources(texts))
        fresh = e.register(make_sources({"n1": "a new b fresh", "n2": "e new f late"}, 1), 1)
        e.batches[1] = fresh
        up = prune.chains(e.state.hkts, e.state.nodes, e.state.hkts).groupBy("hkt_id").count().collect()
        targets = sorted(r["hkt_id"] for r in up if r["count"] == 1)
        assert len(targets) >= 2
        n1, n2 = (r["source"] for r in fresh.orderBy("source_id").select("source").collect())
        scoped = spark.createDataFrame([(targets[0], n1), (targets[0], n2), (targets[1], n2)], "hkt_id int, source long")
        above = spark.createDataFrame([(targets[0], "a"), (targets[1], "b"), (targets[1], "zz")], "hkt_id int, token string")
        if together:
            below = [r["hkt_id"] for r in up if r["count"] == 2]
            assert e.rebuild_forest(targets + below[:1], scoped, above) == targets
        else:
            for t in targets:
                assert e.rebuild_subtree(t, scoped.filter(F.col("hkt_id") == t).select("source"), above.filter(F.col("hkt_id") == t).select("token"))
        invariants(e)
        states.append((flat(e), sorted(e.removed.items()), e.next_hkt_id, e.next_node_id))
    assert states[0] == states[1]
    none = spark.createDataFrame([], "hkt_id int, source long"), spark.createDataFrame([], "hkt_id int, token string")
    assert e.rebuild_forest([], *none) == [] and e.rebuild_forest([998], *none) == []


def test_configuration():
    for bad in ({"alpha": 1.5}, {"beta": -0.1}, {"alpha_option1_threshold": 2.0}, {"selected_alpha_option": "Option4"}):
        with pytest.raises(InvalidConfiguration):
            ThresholdConfig(**bad)
    with pytest.raises(InvalidConfiguration):
        BuilderConfig(similarity_threshold=1.1)
    ThresholdConfig(alpha_error_threshold=7.0)
    c = Config()
    assert Config.from_dict(c.to_dict(), strict=True) == c and Config.from_dict({}) == c
    with pytest.raises(InvalidConfiguration):
        Config.from_dict({"hkt_builder": {}}, strict=True)
