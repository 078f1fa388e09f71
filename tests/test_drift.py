"""Expected numbers were worked out by hand from the formulas."""

import pytest
from pyspark.sql import functions as F

from driftgrove.config import BuilderConfig, Config, ThresholdConfig
from driftgrove.engine import Engine
from driftgrove.operators import drift


def engine(spark, make_sources, texts, builder=BuilderConfig(), **thresholds):
    e = Engine(spark, Config(builder, ThresholdConfig(**thresholds)))
    e.build_baseline(make_sources(texts))
    return e


def one_node(e, spark, words, without_sources=False):
    """Puts the words into the root's first node, with the sources that hold them, and drops all other nodes."""
    first = e._first()
    root = e.state.hkts.filter("parent_node_id = 0")
    legend = e.vocabulary
    node = 1
    pairs = first.filter(F.col("token").isin(words)).select(F.lit(node).alias("node_id"), "token", "source")
    if without_sources:
        pairs = pairs.limit(0)
    nodes = e.state.nodes.filter(F.col("node_id") == node)
    e.state = drift.State(
        root, nodes, legend.filter(F.col("token").isin(words)).select(F.lit(node).alias("node_id"), "token", "word_id"), pairs.select("node_id", "source").distinct(), pairs,
        spark.createDataFrame([(1, w) for w in words[1:]], "hkt_id int, token string"),
    ).kept()
    return e


def level(e, make_sources, texts):
    held = e.register(make_sources(texts, 1), 1)
    return drift.root_level(e.state, held.select("source"), e._tokens(held), e._first(), e.config.thresholds, e.vocabulary.select("token"))


def errors(e, make_sources, texts):
    return level(e, make_sources, texts).errors.first().asDict()


SKEW = {f"s{i}": "a" for i in range(1, 5)} | {"s5": "b"}


def test_alpha_errors_and_importance(spark, make_sources):
    e = one_node(engine(spark, make_sources, SKEW, BuilderConfig(0.0, 0.5, 1), alpha=0.6), spark, ["a", "b"])
    got = errors(e, make_sources, {"n1": "a"})
    assert (got["alpha1"], got["alpha2"], got["alpha3"]) == (0.2, 0.025, 0.05)
    assert got["wi2"] == 0.0471 and got["n"] == 2


def test_beta_errors(spark, make_sources):
    e = one_node(engine(spark, make_sources, {"s1": "a", "s2": "a b"}, BuilderConfig(0.0, 0.5, 1), beta=0.8), spark, ["a", "b"])
    got = errors(e, make_sources, {"n1": "a", "n2": "b"})
    assert (got["beta2"], got["beta3"]) == (0.125, 0.25)


def test_importance_of_words_without_a_node(spark, make_sources):
    e = one_node(engine(spark, make_sources, {"s1": "a", "s2": "a"}, alpha=0.0, beta=1.0), spark, ["a"])
    # the new word takes no node; neither of the batch's sources holds a known word
    assert errors(e, make_sources, {"n1": "new_x", "n2": "new_x"})["wi1"] == 0.5


def test_beta_triggers(spark, make_sources):
    e = one_node(engine(spark, make_sources, {"s1": "a", "s2": "b", "s3": "c"}, BuilderConfig(0.0, 0.5, 1), beta=0.8, beta_option1_threshold=0.1), spark, ["a", "b", "c"], True)
    at = level(e, make_sources, {f"n{i}": "a" for i in range(1, 5)})
    assert at.errors.first()["beta1"] == 0.5333
    assert "beta" in at.decisions("PaperDiagnosticScaffold").first()["reasons"].split(",")


def test_change_metrics(spark, make_sources):
    e = one_node(engine(spark, make_sources, {"s1": "a", "s2": "a", "s3": "a"}, alpha=0.0, beta=0.0), spark, ["a"])
    got = {r["token"]: r for r in level(e, make_sources, {"n1": "a new_x", "n2": "a new_x"}).word_change.collect()}
    a, x = got["a"], got["new_x"]
    assert (a["before"], a["new"], a["after"], a["importance0"], a["strength1"]) == (3, 2, 5, 1.0, 1.0)
    assert a["importance1"] == pytest.approx(5 / 7)
    assert (x["before"], x["new"], x["after"], x["strength1"], x["eligibility1"]) == (0, 2, 2, 0.4, 0.4)
    assert x["importance1"] == pytest.approx(2 / 7)


def test_expected_word_without_node(spark, make_sources):
    e = one_node(engine(spark, make_sources, {"s1": "a", "s2": "a"}, alpha=0.0, beta=1.0), spark, ["a"])
    got = {r["token"]: r for r in level(e, make_sources, {"n1": "a new_x", "n2": "new_x"}).word_change.collect()}
    x = got["new_x"]
    assert (x["node_id"], x["before"], x["new"], x["after"]) == (0, 0, 2, 2)


def test_known_word_without_node(spark, make_sources):
    e = one_node(engine(spark, make_sources, {"s1": "a legacy", "s2": "a legacy"}, alpha=0.0, beta=1.0), spark, ["a"])
    x = {r["token"]: r for r in level(e, make_sources, {"n1": "a legacy"}).word_change.collect()}["legacy"]
    assert (x["node_id"], x["before"], x["new"], x["after"], x["importance1"]) == (0, 0, 1, 3, 0.5)


@pytest.mark.parametrize(
    ("base", "batch", "thresholds", "word", "expected", "assigned"),
    [
        ({"s1": "a", "s2": "a"}, {"n1": "a new_x"}, {"alpha": 0.6}, "new_x", False, False),
        ({f"s{i}": "a" for i in range(10)}, {f"n{i}": "new_x" for i in range(5)}, {"alpha": 0.6}, "new_x", False, False),
        ({f"s{i}": "a" for i in range(10)}, {"n1": "a new_x", "n2": "a new_x"}, {"alpha": 0.0, "beta": 0.5}, "new_x", True, False),
        ({"s1": "a", "s2": "a"}, {"n1": "a new_x", "n2": "a new_x"}, {"alpha": 0.0, "beta": 0.5}, "new_x", True, True),
        ({f"s{i}": "a" for i in range(10)} | {f"s{i}": "legacy" for i in range(10, 17)}, {"n1": "a legacy"}, {"alpha": 0.7}, "legacy", True, None),
    ],
)
def test_admission_and_assignment(spark, make_sources, base, batch, thresholds, word, expected, assigned):
    e = one_node(engine(spark, make_sources, base, **thresholds), spark, ["a"])
    at = level(e, make_sources, batch)
    assert (word in {r["token"] for r in at.expected.collect()}) is expected
    if assigned is not None:
        assert (word in {r["token"] for r in at.assigned.collect()}) is assigned


@pytest.mark.parametrize(("batch", "threshold", "hit"), [({"n1": "a x y"}, 0.4, True), ({"n1": "a x"}, 0.5, False)])
def test_placeholder_policy(spark, make_sources, batch, threshold, hit):
    e = engine(spark, make_sources, {"s1": "a b", "s2": "a c"}, word_importance_error_threshold=threshold)
    got = level(e, make_sources, batch).decisions("Placeholder").first()
    assert got["triggered"] is hit
    if not hit:
        assert got["wi_error"] == 0.5


def test_unmatched_sources_go_to_the_refuge(spark, make_sources):
    texts = {f"s{i}": "a" for i in range(1, 5)} | {"s5": "b", "s6": "c"}
    e = engine(spark, make_sources, texts, BuilderConfig(0.6, 0.5, 1))
    at = level(e, make_sources, {"n1": "a", "n2": "zzz"})
    refuge = {r["node_id"] for r in e.state.nodes.filter("refuge AND hkt_id = 1").collect()}
    got = {(r["node_id"] in refuge, r["source"]) for r in at.routed.collect()}
    assert len(got) == 2 and {x for x, _ in got} == {True, False}


def test_words_above_are_all_accepted(spark, make_sources):
    """Only words of the nodes above are weighed on the way down, and a node's own word is accepted whatever its weight: none is ever rejected, so none can come back."""
    texts = {f"s{i}": t for i, t in enumerate(["a b c x", "a b d", "a c d y", "a d", "a b e", "a c e"])}
    e = engine(spark, make_sources, texts, BuilderConfig(0.3, 0.3, 1), alpha=0.9)
    at = level(e, make_sources, {"n1": "a b q", "n2": "a d c"})
    seen = 0
    while (below := at.below(at.hkts.select("hkt_id"))) is not None:
        own = at.words.select("node_id", "token").unionByName(at.assigned.select("node_id", "token")).withColumnRenamed("node_id", "parent_node_id")
        above = at.accepted.withColumnRenamed("hkt_id", "above").join(at.nodes.select(F.col("node_id").alias("parent_node_id"), F.col("hkt_id").alias("above")), "above").select("parent_node_id", "token")
        want = below.hkts.join(own.unionByName(above), "parent_node_id").select("hkt_id", "token").distinct()
        got = {tuple(r) for r in below.accepted.join(below.hkts.select("hkt_id"), "hkt_id").select("hkt_id", "token").collect()}
        assert got == {tuple(r) for r in want.collect()}
        seen += len(got)
        at = below
    assert seen
