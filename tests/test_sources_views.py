import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from driftgrove.__main__ import main
from driftgrove.config import Config, ThresholdConfig
from driftgrove.engine import Engine, save_json
from driftgrove.functions import text as tx
from driftgrove.operators import postings as po
from driftgrove.operators import export, views
from driftgrove import tables
from driftgrove.tables import numbered
from driftgrove.sources import batches, timeline
from driftgrove.streaming.stream import StreamedEngine, file_stream
from test_engine import QUAKE, flat, never


def test_fnv_trim_and_rounding(spark):
    rows = spark.createDataFrame([("s0",), ("row_000001",), ("a",), ("é" * 3,), ("",), (None,)], "s string")

    def fnv(s):
        h = 14695981039346656037
        for b in s.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h - 2**64 if h >= 2**63 else h

    assert [r[1] for r in rows.select("s", tx.fnv1a_64(F.col("s"))).collect()] == [None if s is None else fnv(s) for s in ("s0", "row_000001", "a", "é" * 3, "", None)]
    assert fnv("s0") == 637538656335744918
    assert spark.createDataFrame([("　  a b \t",)], "s string").select(tx.trim(F.col("s"))).first()[0] == "a b"
    assert spark.createDataFrame([(0.00015,)], "x double").select(tx.round_half_away(F.col("x"), 4)).first()[0] == 0.0001  # 1.4999999999999998 before rounding


def test_hash_clashes(spark, make_sources, monkeypatch):
    monkeypatch.setattr(po.tx, "fnv1a_64", lambda c: F.length(c).cast("long"))
    got = {r["source_id"]: r["internal_id"] for r in po.source_ids(make_sources({"aa": "x", "bb": "y", "ccc": "z"})).collect()}
    assert got["aa"] == 2 and len(set(got.values())) == 3


def test_chunks(spark, make_sources):
    dealt = batches.chunked(make_sources({f"s{i}": "a" for i in range(10)}), 4)
    assert [r["count"] for r in dealt.groupBy("batch_index").count().orderBy("batch_index").collect()] == [3, 3, 2, 2]
    assert [r["batch_index"] for r in dealt.orderBy("source_index").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    few = batches.chunked(make_sources({"a": "x", "b": "y"}), 4)
    assert [r["batch_index"] for r in few.orderBy("source_index").collect()] == [0, 1]
    assert batches.chunks_of_size(10, 4) == 3


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('Title,ShortSummary,URL\n"Storm,  hits ""coast""",The CITY,http://x\n,,\nthe,,\nRescue\n')
    rows = numbered(batches.read_csv(spark, f"file://{path}").withColumn("at", F.monotonically_increasing_id()), ["at"], "n").drop("at")
    got = batches.csv_sources(rows, "n").orderBy("source_index").collect()
    assert [(r["source_id"], r["tokens"]) for r in got] == [("row_000001", ["storm", "hits", "coast", "city"]), ("row_000004", ["rescue"])]
    assert json.loads(got[0]["metadata"]) == {"url": "http://x"} and got[0]["text"] == 'Storm, hits "coast" The CITY'


def test_json_round_trip_and_catalog(spark, make_sources, tmp_path):
    path = str(tmp_path / "b.json")
    rows = make_sources({"s1": "a b", "s2": "c"}).withColumn("text", F.when(F.col("source_id") == "s1", "  Some title  ")).withColumn("metadata", F.lit('{"URL": "http://u"}'))
    batches.write_batch_json(rows, path)
    back = batches.read_json_batch(spark, f"file://{path}")
    assert [(r["source_index"], r["source_id"], r["tokens"]) for r in back.orderBy("source_index").collect()] == [(0, "s1", ["a", "b"]), (1, "s2", ["c"])]
    assert {r["source_id"]: (r["title"], r["url"]) for r in batches.catalog(rows).collect()} == {"s1": ("Some title", "http://u"), "s2": ("c", "http://u")}
    lines = tmp_path / "lines.json"
    lines.write_text('{"source_id": "b", "tokens": ["x"]}\n{"source_id": "a", "tokens": ["y"]}\n')
    assert [r["source_id"] for r in batches.read_json_sources(spark, f"file://{lines}").orderBy("source_index").collect()] == ["a", "b"]


def test_prefix_sends_no_scope_to_one_task(spark):
    """A scope's rows meet its first row and first miss without an exchange by scope, with the same words as row by row."""
    r = random.Random(4)
    df = {(s, t): r.randint(1, 9) for s in "ab" for t in range(30)}
    rows = [(s, i, k, f"t{t}", df[s, t]) for s in "ab" for i in range(40) for k, t in enumerate(r.sample(range(30), 3))] + [(None, 0, 0, "t", 1)]
    want = set()
    for s in "ab":
        own = sorted(x for x in rows if x[0] == s)
        for x in own:
            if x[4] / own[0][4] < 0.5:
                break
            want.add((s, x[3]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = po.expected_prefix(spark.createDataFrame(rows, "scope string, first long, nth int, token string, df int"), 0.5)
        assert "SortMergeJoin" not in made._jdf.queryExecution().toString()
        assert {tuple(x) for x in made.collect()} == want and want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_any_shape_of_json(spark, tmp_path):
    one, two = '{"source_id": "b", "tokens": ["x"]}', '{"source_id": "a", "tokens": ["y"]}'
    shapes = {"lines": f"{one}\n{two}\n", "array": f"[{one},\n {two}]", "batch": f'{{"batch_index": 3,\n "sources": [{one}, {two}]}}', "batches": f'{{"batch_index": 0, "sources": [{one}]}}\n{{"batch_index": 1, "sources": [{two}]}}'}
    for name, body in shapes.items():
        (tmp_path / f"{name}.json").write_text(body)
        rows = batches.read_upload(spark, f"file://{tmp_path}/{name}.json").collect()
        assert {(r["source_id"], tuple(r["tokens"])) for r in rows} == {("b", ("x",)), ("a", ("y",))}, name
    assert [r["source_id"] for r in batches.read_batch(spark, f"file://{tmp_path}/batch.json").orderBy("source_index").collect()] == ["b", "a"]
    (tmp_path / "t.csv").write_text("Title,URL\n Storm,http://x\n")
    assert batches.read_upload(spark, f"file://{tmp_path}/t.csv").first()["URL"] == "http://x"
    with pytest.raises(ValueError):
        batches.read_upload(spark, "file:///t.xml")
    back = batches.read_batch(spark, f"file://{tmp_path}/lines.json")
    batches.write_lines(back, f"file://{tmp_path}/out")
    assert {r["source_id"] for r in batches.read_batch(spark, f"file://{tmp_path}/out").collect()} == {"a", "b"}


def test_one_large_document_is_read_by_many_tasks(spark, tmp_path):
    r = [{"source_id": f"s{i:03d}", "tokens": ["a{", "}b", '"', "\\\\", "[]}", f"t{i}"], "text": 'x } "y" \\ { ' * (i % 7) + "é😀", "metadata": "{}"} for i in range(60)]
    shapes = {"wrapped": {"batch_index": 4, "sources": r}, "late": {"sources": r, "batch_index": 4}, "array": r}
    names = ["batch_index", "source_index", "source_id", "tokens", "text", "metadata"]
    for name, doc in shapes.items():
        for indent in (None, 2):
            path = f"{tmp_path}/{name}{indent}.json"
            with open(path, "w") as f:
                json.dump(doc, f, indent=indent, ensure_ascii=bool(indent))
            want = sorted(map(tuple, batches.read_batch(spark, f"file://{path}").select(names).collect()), key=str)
            for size in ("900", "128m"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                found = batches.read_split(spark, f"file://{path}").select(names)
                assert sorted(map(tuple, found.collect()), key=str) == want and len(want) == 60
                parts = spark.read.option("lineSep", "}").text(f"file://{path}").rdd.getNumPartitions()
                assert (parts > 5) == (size == "900")


def test_dates_and_defaults(spark):
    today = datetime.date.today()
    rows = spark.createDataFrame([("86400000",), ("0",), ("x",), (None,), ("1.5e12",)], "ms string").select(views.local_date(F.col("ms"), F.lit(today)).alias("d")).collect()
    assert [r["d"] for r in rows] == [datetime.date(1970, 1, 2), today, today, today, datetime.date(2017, 7, 14)]
    table = spark.createDataFrame([("3", "2024-02-30"), ("x", "2024-02-28"), (None, None)], "value string, date string")
    got = views.with_defaults(table, {"topic": "'none'", "value": "5"}).collect()
    assert [(r["value"], r["date"], r["topic"]) for r in got] == [(3.0, None, "none"), (1.0, datetime.date(2024, 2, 28), "none"), (1.0, None, "none")]


def test_partitions_are_pruned(spark, make_sources, tmp_path):
    dealt = batches.chunked(make_sources({f"s{i}": "a" for i in range(8)}), 4)
    batches.write_partitions(dealt, f"file://{tmp_path}/p")
    rows = batches.read_window(spark, f"file://{tmp_path}/p", 1, 2)
    assert {r["batch_index"] for r in rows.collect()} == {1, 2} and rows.count() == 4
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_index" in plan


@pytest.fixture(scope="module")
def quake(spark):
    rows = [(0, i, s, t.split(" "), None, None, None) for i, (s, t) in enumerate(QUAKE[0].items())]
    sources = spark.createDataFrame(rows, "batch_index long, source_index long, source_id string, tokens array<string>, text string, timestamp_unix_ms long, metadata string")
    e = Engine(spark)
    e.build_baseline(sources)
    return e.tree(), sources


def test_views(quake):
    tree, sources = quake
    view = {r["node_id"]: r for r in views.tree_view(tree).collect()}
    assert {i: (r["parent"], r["depth"], r["category"]) for i, r in view.items()} == {1: ("", 0, "damage"), 2: ("", 0, "damage"), 3: ("", 0, "damage"), 4: ("node:1", 1, "damage"), 5: ("node:1", 1, "damage")}
    assert view[1]["label"] == "earthquake damage city rescue" and view[1]["strength_pct"] == 1.0
    assert {r["node_id"]: r["path"] for r in views.node_paths(tree).collect()}[5] == "earthquake damage city rescue ▶ storm coast"
    assert views.validation(tree).first().asDict() == {"total_hkts": 2, "total_nodes": 5, "rendered_nodes": 5, "skipped_nodes": 0}
    frame = views.tree_view(tree)
    assert {r["node_id"] for r in views.subtree_filter(frame, "damage", 1).collect()} == {1, 4, 5}
    assert views.subtree_filter(frame, "nothing").count() == 0
    assert [r["node_id"] for r in views.explorer(frame, "RESCUE", max_depth=0).collect()] == [1, 2]
    rows = views.source_assignments(tree, batches.catalog(sources))
    assert rows.count() == 7
    assert views.assignment_filter(rows, "damage", 2).count() == 1
    assert [r["source_id"] for r in views.source_search(rows, "COAST").collect()] == ["s3"]
    assert views.source_search(rows, with_url=True).count() == 0
    mapped = views.treemap(rows).collect()
    assert {(r["id"], r["value"]) for r in mapped} == {("hkt:damage", 3), ("src:damage::s1", 1), ("src:damage::s2", 1), ("src:damage::s3", 1)}


def test_exports(quake):
    tree, _ = quake
    plain, verbose = tree.plain(), tree.verbose()
    assert [h["node_ids"] for h in plain["hkts"]] == [[1, 2, 3], [4, 5]]
    assert [w["token"] for w in verbose["word_legend"]] == ["earthquake", "damage", "city", "rescue", "storm", "coast"]
    assert tree.outline().split("\n") == [
        "HKT 1", "  node 1: earthquake, damage, city (3 sources)", "    HKT 2", "      node 4: rescue (1 sources)", "      node 5: storm, coast (1 sources)", "  node 2: rescue (1 sources)",
        "  node 3: storm, coast (1 sources)",
    ]
    assert verbose["hkts"][1].keys() == {"hkt_id", "parent_node_id", "expected_words", "all_node_words_union", "node_ids", "is_state1"} and not verbose["hkts"][1]["is_state1"]
    assert plain["nodes"][0].keys() == {"node_id", "hkt_id", "word_ids", "source_ids", "top_words", "is_refuge_node"} and plain["nodes"][0]["top_words"] == [1, 2, 3, 4, 5, 6]
    assert verbose["nodes"][3]["words"] == [{"word_id": 4, "token": "rescue"}] and verbose["nodes"][3]["sources"][0]["external_source_id"] == "s2"


def test_trees_are_read_back(spark, quake, tmp_path):
    tree, sources = quake
    save_json(tree.verbose(), str(tmp_path / "tree.json"))
    tree.write_json(f"file://{tmp_path}/lines")
    rows = lambda df: sorted(tuple(r) for r in df.drop("date").collect())
    for back in (export.read_tree(spark, f"file://{tmp_path}/tree.json"), export.read_tree_lines(spark, f"file://{tmp_path}/lines")):
        assert back.verbose() == tree.verbose() and back.outline() == tree.outline()
        assert rows(views.tree_view(back, source_ids=True)) == rows(views.tree_view(tree, source_ids=True))
        assert rows(views.source_assignments(back, batches.catalog(sources))) == rows(views.source_assignments(tree, batches.catalog(sources)))
    assert {(r[0], r[1]) for r in tree.edges().collect()} == {(1, 2)}


def test_one_document_is_put_together_from_parts(spark, make_sources, tmp_path):
    e = Engine(spark, never())
    e.build_baseline(make_sources({f"s{i} \"é\\": f'a b{i % 3} "q\\ {{]' for i in range(12)}))
    tree = e.tree()
    path = f"{tmp_path}/tree.json"
    tree.write_document(f"file://{path}", size=2)
    with open(path) as f:
        found = json.load(f)
    for n in found["nodes"]:
        n["sources"].sort(key=lambda x: x["internal_source_id"])
    assert found == tree.verbose()
    parts = tree.source_parts(2).groupBy("node_id").agg(F.max(F.size("sources")).alias("most"), F.count(F.lit(1)).alias("n")).collect()
    assert max(r["n"] for r in parts) > 3 and max(r["most"] for r in parts) < 12
    assert export.read_tree(spark, f"file://{path}").outline() == tree.outline()


def test_chunks_of_equal_indices(spark):
    """Cuts between sources of one index, where it can't tell the batches apart."""
    for values in ([0, 0, 0, 1, 1, 2, 5], [3] * 5, [1, 2], []):
        rows = spark.createDataFrame([(v, "x") for v in values], "source_index long, source_id string")
        got = sorted((r["source_index"], r["batch_index"]) for r in batches.chunked(rows, 3).collect())
        size, more = divmod(len(values), 3)
        want = [k for k in range(3) for _ in range(size + (k < more))]
        assert [v for v, _ in got] == sorted(values) and sorted(b for _, b in got) == want
        assert all(a[1] <= b[1] for a, b in zip(got, got[1:]) if a[0] < b[0])


def test_timeline(spark, make_sources, tmp_path):
    texts = QUAKE[0] | QUAKE[1] | QUAKE[2]
    out = str(tmp_path / "line")
    made = timeline.write_timeline(Engine(spark, never()), make_sources(texts), out, 3)
    assert made["total_batches"] == 3 and made["sources_total"] == 7
    rows = timeline.read_timeline(spark, out).collect()
    assert [r["file"] for r in rows] == made["files"] and rows[-1]["sources"] == 7
    assert views.validation(timeline.timeline_tree(spark, out)).first()["total_hkts"] == rows[-1]["hkts"]
    os.remove(f"{out}/{made['files'][1]}")
    with pytest.raises(FileNotFoundError):
        timeline.read_timeline(spark, out)


def test_stream_restarts(spark, make_sources, tmp_path):
    stream, at = f"file://{tmp_path}/in", f"file://{tmp_path}/engine"
    made = StreamedEngine(spark, at, never())
    made.apply(make_sources({}).select("source_index", "source_id", "tokens"), 0)
    assert made.version() == -1
    for i, texts in enumerate(QUAKE):
        make_sources(texts).select("source_index", "source_id", "tokens").coalesce(1).write.mode("append").parquet(stream)
        made.start(file_stream(spark, stream), f"file://{tmp_path}/check").awaitTermination()
        assert made.version() == i
    made.apply(make_sources(QUAKE[2]).select("source_index", "source_id", "tokens"), 2)  # delivered again
    assert not (tmp_path / "engine" / "v2" / "batch-1-0").exists() and (tmp_path / "engine" / "v1" / "batch-1-0").exists()  # referred to
    e = Engine(spark, never())
    for i, texts in enumerate(QUAKE):
        e.process_batch(make_sources(texts), i) if i else e.build_baseline(make_sources(texts))
    assert flat(made.engine()) == flat(e)


def test_versions_write_what_is_new_and_go_when_unused(spark, make_sources, tmp_path):
    path = f"{tmp_path}/versions"
    plain = Engine(spark, never())
    streamed = StreamedEngine(spark, f"file://{path}", never())
    words = ["earthquake damage city", "storm damage coast", "earthquake city", "city coast storm"]
    for i in range(3):
        rows = make_sources({f"s{i}_{k}": w for k, w in enumerate(words * (10 if i == 0 else 1))}, i)
        streamed.apply(rows, i)
        plain.process_batch(rows, i) if i else plain.build_baseline(rows, i)
    assert flat(streamed.engine()) == flat(plain)
    with open(next(p for p in (os.path.join(path, "v2", "control", f) for f in os.listdir(f"{path}/v2/control")) if p.endswith(".txt"))) as f:
        tables = json.loads(f.read())["tables"]
    assert len(tables["state-word_sources"]) == 3 and len(tables["registry"]) == 3
    sizes = [spark.read.parquet(p).count() for p in tables["state-word_sources"]]
    assert sizes[0] > 5 * max(sizes[1:]) > 0
    held = {os.path.join(v, t) for v in os.listdir(path) if v != "pointer" for t in os.listdir(f"{path}/{v}") if t != "control"}
    named = {"/".join(p.split("/")[-2:]) for places in tables.values() for p in places}
    assert named <= held and {v for v in os.listdir(path) if os.path.exists(f"{path}/{v}/control")} == {"v1", "v2"}
    assert not streamed.sweep()


def test_command_line(spark, make_sources, tmp_path, capsys):
    batch = str(tmp_path / "b.json")
    batches.write_batch_json(make_sources(QUAKE[0]), batch)
    Config(thresholds=ThresholdConfig(alpha=0.7)).save(str(tmp_path / "c.json"))
    assert main(["baseline", batch, "--config", str(tmp_path / "c.json"), "--dump-tree", str(tmp_path / "t.json"), "--snapshot-out", str(tmp_path / "s.json"), "--print"]) == 0
    assert "HKT 1" in capsys.readouterr().out
    assert len(json.load(open(tmp_path / "t.json"))["nodes"]) == 5
    assert json.load(open(tmp_path / "s.json"))["config"]["thresholds"]["alpha"] == 0.7
    save_json({"a": 1}, str(tmp_path / "x" / "y.json"))
    table = tmp_path / "t.csv"
    table.write_text("Title\nStorm coast\n")
    assert main(["from-csv", str(table), str(tmp_path / "lines"), "--lines"]) == 0
    assert [r["tokens"] for r in batches.read_batch(spark, str(tmp_path / "lines")).collect()] == [["storm", "coast"]]
    assert main(["from-csv", str(table), str(tmp_path / "csv.json")]) == 0
    assert json.load(open(tmp_path / "csv.json"))["sources"][0]["tokens"] == ["storm", "coast"]


def test_one_large_document_is_written_and_read_without_further_copies(spark, make_sources, tmp_path, monkeypatch):
    """Of the text only the sources at the ends of byte ranges are written again, once, and nothing that was exchanged or put together stays."""
    written, materialise = [], batches.materialise
    monkeypatch.setattr(batches, "materialise", lambda df, name: written.append((name, materialise(df, name))) or written[-1][1])
    path, at = f"file://{tmp_path}/b.json", f"{tables.shared_dir(spark).removeprefix('file://')}"
    before = set(os.listdir(at))
    batches.write_batch_document(make_sources({f"s{i:04d}": 'w%d } "{ x' % i for i in range(500)}), path)
    assert not set(os.listdir(at)) - before
    whole = os.path.getsize(f"{tmp_path}/b.json")
    assert len(json.loads((tmp_path / "b.json").read_text())["sources"]) == 500
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    found = batches.read_split(spark, path)
    rows = sorted((r["source_index"], r["source_id"], *r["tokens"]) for r in found.collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(i, f"s{i:04d}", f"w{i}", "}", '"{', "x") for i in range(500)]
    assert [name for name, _ in written] == ["json-edges"]
    assert 0 < sum(len(r["text"]) for r in written[0][1].collect()) < whole / 5
