import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrove.config import BuilderConfig
from driftgrove.engine import Engine
from driftgrove.operators import postings as po
from driftgrove.operators import tree as tr
from driftgrove.tables import numbered

QUAKE = {"s1": "earthquake damage city", "s2": "earthquake rescue city", "s3": "storm damage coast"}
SMALL = {"s1": "a b c", "s2": "a b", "s3": "a d"}


def built(spark, sources, config=BuilderConfig(), small=tr.SMALL, **more):
    """The tree by token; without ``small`` scopes it is numbered by Spark too."""
    more.setdefault("places", tr.PLACES if small else 0)
    vocab = po.vocabulary(sources)
    rows = po.first_places(sources).join(vocab, "token").select(F.col("source_index").alias("source"), F.col("word_id").alias("word"), F.col("source_index").alias("first"), "nth")
    names = {r["word_id"]: r["token"] for r in vocab.collect()} | {-1: "<REFUGE>"}
    t = tr.build(rows, config, small, **more)
    out = {}
    for n in t.nodes.collect():
        out[n["node_id"]] = {"hkt": n["hkt_id"], "words": set(), "sources": set(), "top": set(), "refuge": n["refuge"]}
    for r in t.node_words.collect():
        out[r["node_id"]]["words"].add(names[r["word_id"]])
    for r in t.node_sources.collect():
        out[r["node_id"]]["sources"].add(r["source"])
    for r in t.top_words.collect():
        out[r["node_id"]]["top"].add(names[r["word_id"]])
    hkts = {r["hkt_id"]: r["parent_node_id"] for r in t.hkts.collect()}
    expected = {}
    for r in t.expected.collect():
        expected.setdefault(r["hkt_id"], set()).add(names[r["word_id"]])
    return out, hkts, expected


@pytest.mark.parametrize("small", [tr.SMALL, 0])
def test_quake(spark, make_sources, small):
    nodes, hkts, expected = built(spark, make_sources(QUAKE), small=small)
    assert hkts == {1: 0, 2: 1}
    assert expected == {1: {"damage", "city", "rescue", "storm", "coast"}, 2: {"storm", "coast"}}
    assert {i: (n["hkt"], n["words"], n["sources"]) for i, n in nodes.items()} == {
        1: (1, {"earthquake", "damage", "city"}, {0, 1, 2}), 2: (1, {"rescue"}, {1}), 3: (1, {"storm", "coast"}, {2}), 4: (2, {"rescue"}, {1}), 5: (2, {"storm", "coast"}, {2}),
    }
    assert nodes[1]["top"] == {"earthquake", "damage", "city", "rescue", "storm", "coast"}


@pytest.mark.parametrize("small", [tr.SMALL, 0])
def test_small(spark, make_sources, small):
    nodes, hkts, expected = built(spark, make_sources(SMALL), small=small)
    assert hkts == {1: 0, 2: 1} and expected == {1: {"b"}, 2: {"d"}}
    assert {i: (n["hkt"], n["words"], n["sources"]) for i, n in nodes.items()} == {1: (1, {"a", "b"}, {0, 1, 2}), 2: (2, {"c"}, {0}), 3: (2, {"d"}, {2})}
    assert nodes[1]["top"] == {"a", "b", "c", "d"}


def test_first_seen_wins_ties(spark, make_sources):
    nodes, _, _ = built(spark, make_sources({"s1": "b", "s2": "a"}))
    assert nodes[1]["words"] == {"b"}


@pytest.mark.parametrize("small", [tr.SMALL, 0])
def test_refuge_child(spark, make_sources, small):
    texts = {f"s{i}": "a" for i in range(1, 5)} | {"s5": "b", "s6": "c"}
    nodes, hkts, _ = built(spark, make_sources(texts), BuilderConfig(0.6, 0.5, 1), small)
    refuge = next(i for i, n in nodes.items() if n["refuge"])
    assert nodes[refuge]["words"] == {"<REFUGE>"} and nodes[refuge]["sources"] == {4, 5}
    child = next(h for h, p in hkts.items() if p == refuge)
    first = min(i for i, n in nodes.items() if n["hkt"] == child)
    assert nodes[first]["words"] == {"b"}


@pytest.mark.parametrize("seed", range(3))
def test_levels_agree_with_subtrees(spark, make_sources, seed):
    r = np.random.default_rng(seed)
    texts = {f"s{i}": " ".join(r.choice(list("abcdef"), size=r.integers(1, 5), p=np.array([6, 5, 4, 3, 2, 1]) / 21)) for i in range(20)}
    config = BuilderConfig(float(r.choice([0.3, 0.5, 0.7])), float(r.choice([0.0, 0.5, 0.8])), int(r.choice([1, 3])))
    a, b, c = built(spark, make_sources(texts), config, tr.SMALL), built(spark, make_sources(texts), config, 0, wide=0), built(spark, make_sources(texts), config, 40)
    assert a == b == c
    wide = 2 if seed == 2 else tr.WIDE
    assert built(spark, make_sources(texts), config, tr.SMALL, arrival=True) == built(spark, make_sources(texts), config, 0, arrival=True, wide=wide)
    nodes, hkts, _ = a
    assert all(n["words"] and n["sources"] for n in nodes.values())
    assert all(p == 0 or p in nodes for p in hkts.values()) and {n["hkt"] for n in nodes.values()} == set(hkts)


@pytest.mark.parametrize("most", [tr.SIGNATURES, 6, 0])
def test_blocks_of_words_fold_as_one_by_one(spark, monkeypatch, most):
    r = np.random.default_rng(4)
    sets, size = {}, 40
    for p in ("a", "b"):
        for _ in range(120):
            s = tuple(sorted(set((r.zipf(1.3, r.integers(1, 9)) % size).tolist())))
            sets[p, s] = sets.get((p, s), 0) + int(r.integers(1, 4))
    patterns = spark.createDataFrame([(p, list(s), n) for (p, s), n in sets.items()], "scope string, pattern array<int>, n long")
    df = {}
    for (p, s), n in sets.items():
        for w in s:
            df[p, w] = df.get((p, w), 0) + n
    seed = {p: max((k for k in df if k[0] == p), key=lambda k: (df[k], -k[1])) for p in ("a", "b")}
    expected = spark.createDataFrame([(p, w, n, (p, w) == seed[p]) for (p, w), n in df.items()], "scope string, word int, df long, seed boolean")
    calls = []
    real = tr.signatures
    monkeypatch.setattr(tr, "signatures", lambda *a, **k: calls.append(1) or real(*a, **k))
    monkeypatch.setattr(tr, "SIGNATURES", most)
    rows = lambda d: sorted((x["scope"], x["ord"], x["word"]) for x in d.collect())
    for similarity in (0.3, 0.6) if most > 6 else (0.4,):
        calls.clear()
        assert rows(tr.fold_by_steps(patterns, expected, similarity)) == rows(tr.fold_by_scope(patterns, expected, similarity))
        assert most < tr.BLOCK or len(calls) <= -(-size // tr.BLOCK)


def test_equal_scopes_are_built_once(spark, make_sources):
    """Going by a, then by b leaves what going by b, then by a does."""
    r = np.random.default_rng(7)
    texts = {f"s{i}": " ".join(r.permutation(list("abcde"))[: r.integers(3, 6)]) for i in range(40)}
    config = BuilderConfig(0.5, 1.0, 3)
    a, b = built(spark, make_sources(texts), config), built(spark, make_sources(texts), config, 0)
    assert a == b
    sources = make_sources(texts)
    vocab = po.vocabulary(sources)
    rows = po.first_places(sources).join(vocab, "token").select(F.col("source_index").alias("source"), F.col("word_id").alias("word"), F.col("source_index").alias("first"), "nth")
    counts = []
    for small in (tr.SMALL, 0):
        t = tr.build(rows, config, small)
        counts.append((t.scopes.count(), t.scopes.select("scope").distinct().count()))
    assert counts[0] == counts[1] and counts[0][1] < counts[0][0] / 2, counts


def test_any_index_gives_the_order_of_arrival(spark, make_sources):
    """Indices beyond any packed number, negative ones and those of a huge batch."""
    texts = {"s1": "c d", "s2": "b a", "s3": "a e"}
    plain = make_sources(texts)
    high = plain.withColumn("source_index", F.col("source_index") * F.lit(1 << 60) - F.lit(1 << 61))
    words = lambda rows: [r["token"] for r in po.vocabulary(rows).orderBy("word_id").collect()]
    ranks = lambda rows: [r["token"] for r in po.ranked_words(rows).orderBy("place").collect()]
    assert words(plain) == words(high) == ["c", "d", "b", "a", "e"] and ranks(plain) == ranks(high) == ["a", "c", "d", "b", "e"]
    late = make_sources({"s1": "x"}).withColumn("source_index", F.lit((1 << 28) + 1).cast("long"))
    for first in (late, high.unionByName(late)):
        e = Engine(spark)
        batches = {0: e.register(first, 0), 1: e.register(make_sources({"s9": "y"}), 1), 2: e.register(high.withColumn("tokens", F.array(F.lit("z"))).limit(2), 2)}
        got = [r["token"] for r in po.vocabulary(e._arrivals(batches), clean=True).orderBy("word_id").collect()]
        assert got[-2:] == ["y", "z"] and got.index("x") == len(got) - 3


def test_prefix_ends_at_the_first_miss(spark):
    r = np.random.default_rng(2)
    rows = [(f"k{i % 3}", int(x), int(p), f"t{i}", int(d)) for i, (x, p, d) in enumerate(zip(r.integers(-5, 5, 200) * 2**59, r.permutation(200), r.integers(5, 12, 200), strict=True))]
    want = set()
    for k in ("k0", "k1", "k2"):
        own = sorted(x for x in rows if x[0] == k)
        for x in own:
            if x[4] / own[0][4] < 0.6:
                break
            want.add((k, x[3]))
    got = po.expected_prefix(spark.createDataFrame(rows, "scope string, first long, nth int, token string, df long"), 0.6)
    assert {tuple(x) for x in got.collect()} == want


def test_numbers_over_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    got = numbered(rows, ["v"], "n", 5)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r["n"] for r in got.orderBy("v").collect()] == list(range(5, 5005))
    assert numbered(rows.limit(0), ["v"], "n").count() == 0


def test_no_sources(spark, make_sources):
    nodes, hkts, expected = built(spark, make_sources({"s1": ""}))
    assert (nodes, hkts, expected) == ({}, {}, {})


def test_levels_exchange_no_source(spark):
    """Below the root a level's sources are rows with all their postings, told apart where they lie: the plan of what a level writes of them exchanges none."""
    rows = spark.range(40).select(F.lit("root").alias("scope"), F.col("id").alias("source"), F.expr("transform(sequence(0, 5), i -> struct(cast((id * (i + 1)) % 7 as int) * 6 + i as word, id as first, cast(i as int) as nth))").alias("posts"))
    nodes, held, _ = tr._level(rows, 1, BuilderConfig(0.3, 0.5, 3))
    of = {(r["ord"], w) for r in held.collect() for w in r["own"]}
    assert of == {(r["ord"], r["word"]) for r in nodes.collect()}
    for r in held.collect():
        assert r["refuge"] == (not r["own"]) and len(r["own"]) + len(r["rest"]) == 6
        assert not {p["word"] for p in r["rest"]} & {w for o, w in of if o == r["ord"]}
    written = []
    real = tr.materialise
    tr.materialise = lambda df, name: written.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name)
    try:
        tr._level(rows, 1, BuilderConfig(0.3, 0.5, 3))
    finally:
        tr.materialise = real
    plan = next(p for name, p in written if name == "tree-held")
    # the only aggregates are those of words by scope, which are broadcast
    assert plan.count("Aggregate [scope") == plan.count("Aggregate [") == 2 and "source" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)
