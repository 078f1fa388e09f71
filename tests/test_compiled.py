"""With whole-stage code generation on, as in production; the other tests run without it."""

import pytest
from test_engine import QUAKE
from test_tree import QUAKE as TREE
from test_tree import built

from driftgrove.engine import Engine
from driftgrove.operators import postings


@pytest.fixture
def compiled(spark):
    names = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_tree_and_batch(compiled, make_sources):
    nodes, hkts, _ = built(compiled, make_sources(TREE))
    assert hkts == {1: 0, 2: 1} and len(nodes) == 5
    e = Engine(compiled)
    e.build_baseline(make_sources(QUAKE[0]))
    e.process_batch(make_sources(QUAKE[1]), 1)
    texts = {r["text"].split(":")[0] for r in e.update_notes().collect()}
    assert any(t.startswith("HKT 1") for t in texts)


def test_words(compiled, make_sources):
    long = " ".join(f"w{i % 1500}" for i in range(4000))
    rows = make_sources({"s1": " b a  b ", "s2": long, "s3": ""})
    got = {(r["source_id"], r["token"]): r["nth"] for r in postings.first_places(rows).collect()}
    want = {}
    for s, t in (("s1", " b a  b "), ("s2", long)):
        for i, w in enumerate(dict.fromkeys(t.split(" "))):
            if w:
                want[s, w] = i
    assert got == want
    assert {r["token"]: r["df"] for r in postings.word_df(rows.unionByName(rows)).collect()} == {w: 1 for _, w in want}
