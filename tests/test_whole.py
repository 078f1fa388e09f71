"""Queries that must see all of a table: against brute force over small tables of their own."""

import re

from driftgrove.operators import postings
from driftgrove.functions.text import STOP_WORDS
from driftgrove.plans import queries


def tokens(text):
    return [w for w in (x.lower() for x in re.findall("[A-Za-z0-9_]+", text)) if w not in STOP_WORDS]


def write_documents(spark, folder, texts):
    rows = [(i, t, "en", "src1") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_csv_ingest_reads_whole_texts(spark, tmp_path):
    texts = ["the and of " * 8 + "lantern  harbour\n meadow", "word" * 30 + " tail" + " Zebra_1" * 500, "short one", None, "", " \t "]
    got = {r["source_index"]: r for r in queries.REGISTRY["csv_ingest"](spark, write_documents(spark, tmp_path, texts)).collect()}
    want = {}
    for i, t in enumerate(texts):
        body = " ".join(f"{t or ''} en src1".split())
        if len(tokens(body)) >= 3:
            want[i + 1] = (" ".join(tokens(body)), body)
    assert {k: (r["tokens"], r["text"]) for k, r in got.items()} == want
    assert got[1]["tokens"].startswith("lantern harbour meadow") and got[2]["tokens"].count("zebra_1") == 500


def test_containment_compares_all_expected_words(spark, tmp_path):
    texts = [" ".join(f"w{k:02d}" for k in range(20) if (i * 7 + k) % 20 < 16) + f" rare{i}" for i in range(40)] + [None, "w00 w19 w19 late"]
    got = {(r["token"], r["other"]): r["share"] for r in queries.REGISTRY["containment"](spark, write_documents(spark, tmp_path, texts)).collect()}
    sets = [set(tokens(t or "")) for t in texts]
    held = {w: {i for i, s in enumerate(sets) if w in s} for w in set().union(*sets)}
    most = max(map(len, held.values()))
    expected = [w for w in held if len(held[w]) / most >= 0.5]
    assert len(expected) == 20
    want = {(a, b): len(held[a] & held[b]) / len(held[a]) for a in expected for b in expected if held[a] & held[b]}
    assert got == want


def test_sources_are_told_before_they_are_cut_into_tokens(spark):
    """A source in several rows counts whole, one without an index not, and no row of tokens is joined where none comes twice."""
    schema = "source_index long, source_id string, tokens array<string>"
    rows = [(1, "a", ["x", "y"]), (2, "b", ["y"]), (3, "c", ["x"]), (3, "c", ["z"]), (None, None, ["x"])]
    word = spark.createDataFrame([("x",)], "token string")
    found = postings.holding(spark.createDataFrame(rows, schema), word)
    assert sorted((r[0], *r[2]) for r in found.collect()) == [(1, "x", "y"), (3, "x"), (3, "z")]
    assert postings.holding(spark.createDataFrame(rows, schema), word.limit(0)).count() == 0
    once = postings.holding(spark.createDataFrame(rows[:2], schema), word)
    assert [r[0] for r in once.collect()] == [1] and "SortMergeJoin" not in once._jdf.queryExecution().executedPlan().toString()
