"""The tree as flat tables, as JSON in the exchange format, and as an outline; and back from JSON.

Sources stay rows: only ``plain`` and ``verbose``, for small trees, put all sources of a node side by side.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from driftgrove.operators.drift import State
from driftgrove.tables import materialise, numbered, write_in_order

REFUGE, UNKNOWN = "<REFUGE>", "<UNKNOWN_SOURCE>"
WORDS, SOURCES = "array<struct<word_id:int,token:string>>", "array<struct<internal_source_id:bigint,external_source_id:string>>"
#: The fields of an exported tree.
HKT = f"hkt_id int, parent_node_id int, expected_words {WORDS}, all_node_words_union {WORDS}, node_ids array<int>, is_state1 boolean"
NODE = f"node_id int, hkt_id int, words {WORDS}, sources {SOURCES}, top_words {WORDS}, is_refuge_node boolean"
TREE = f"hkts array<struct<{HKT}>>, nodes array<struct<{NODE}>>, word_legend {WORDS}, source_legend {SOURCES}, logically_removed_hkts array<struct<{HKT}>>"


#: Sources of a node that stand in one row, about.
PART = 10_000


@dataclass(frozen=True)
class TreeExport:
    """Views of a tree version. ``vocabulary``: word_id, token; ``registry``: source_id, source.

    ``removed``: HKTs that rebuilds replaced, with their old parent. ``rebuilt_from``: the first id
    of HKTs that subtree rebuilds made.
    """

    state: State
    vocabulary: DataFrame
    top_words: DataFrame
    registry: DataFrame
    removed: dict[int, int] = field(default_factory=dict)
    rebuilt_from: int | None = None

    def edges(self) -> DataFrame:
        """parent_node_id, child_hkt_id."""
        nodes = self.state.nodes.select(F.col("node_id").alias("parent_node_id"))
        return self.state.hkts.join(nodes, "parent_node_id").select("parent_node_id", F.col("hkt_id").alias("child_hkt_id"))

    def legend(self) -> DataFrame:
        """word_id, token: the vocabulary, then the tree's words that it lacks, by token."""
        known = self.vocabulary.select("word_id", "token")
        used = self.state.node_words.select("token").unionByName(self.state.expected.select("token")).distinct()
        new = numbered(used.join(known.select("token"), "token", "left_anti"), ["token"], "n")
        most = known.agg(F.coalesce(F.max("word_id"), F.lit(0)).alias("most"))
        return known.unionByName(new.join(F.broadcast(most), F.lit(True)).select((F.col("most") + F.col("n")).cast("int").alias("word_id"), "token"))  # one row

    def counts(self) -> DataFrame:
        """node_id, source_count."""
        return self.state.node_sources.groupBy("node_id").agg(F.count(F.lit(1)).alias("source_count"))

    def sources(self) -> DataFrame:
        """node_id, source, source_id: a row per source of a node."""
        named = self.state.node_sources.join(self.registry, "source", "left")
        return named.select("node_id", "source", F.coalesce("source_id", F.lit(UNKNOWN)).alias("source_id"))

    def nodes(self) -> DataFrame:
        """node_id, hkt_id, ord, refuge, words and top_words (word_id, token; in order of id), source_count."""
        s = self.state
        known = materialise(self.legend(), "export-legend")
        words = s.node_words.select("node_id", "token").join(known, "token")
        refuge = s.nodes.filter("refuge").select("node_id", F.lit(-1).alias("word_id"), F.lit(REFUGE).alias("token"))
        listed = lambda df, name: df.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("word_id", "token"))).alias(name))
        packed = listed(words.select("node_id", "word_id", "token").unionByName(refuge), "words")
        top = listed(self.top_words.join(known, "token", "left").select("node_id", "word_id", "token"), "top_words")
        out = s.nodes.join(packed, "node_id", "left").join(top, "node_id", "left").join(self.counts(), "node_id", "left")
        return out.select("node_id", "hkt_id", "ord", "refuge", _filled("words", WORDS), _filled("top_words", WORDS), F.coalesce("source_count", F.lit(0)).cast("int").alias("source_count"))

    def hkts(self) -> DataFrame:
        """hkt_id, parent_node_id, node_ids in order, expected_words and words (all of its nodes) by word id, is_state1."""
        s = self.state
        ids = materialise(self.legend(), "export-legend")
        listed = lambda df, name: df.join(ids, "token").groupBy("hkt_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("word_id", "token"))), lambda x: x["token"]).alias(name))
        nodes = s.nodes.groupBy("hkt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda x: x["node_id"]).alias("node_ids"))
        words = listed(s.node_words.select("node_id", "token").join(s.nodes.select("node_id", "hkt_id"), "node_id"), "words")
        out = s.hkts.join(nodes, "hkt_id", "left").join(listed(s.expected, "expected_words"), "hkt_id", "left").join(words, "hkt_id", "left")
        late = F.lit(False) if self.rebuilt_from is None else F.col("hkt_id") >= self.rebuilt_from
        return out.select("hkt_id", "parent_node_id", _filled("node_ids", "array<int>"), _filled("expected_words", "array<string>"), _filled("words", "array<string>"), late.alias("is_state1"))

    # -- the exchange format

    def node_documents(self) -> DataFrame:
        """The nodes with the fields of an exported tree."""
        held = self.sources().groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct(F.col("source").alias("internal_source_id"), F.col("source_id").alias("external_source_id")))).alias("sources"))
        rows = self.nodes().join(held, "node_id", "left").withColumn("sources", _filled("sources", SOURCES))
        return rows.select("node_id", "hkt_id", "words", "sources", "top_words", F.col("refuge").alias("is_refuge_node"))

    def source_parts(self, size: int = PART) -> DataFrame:
        """node_id, part, sources: the sources of each node by hash, about ``size`` in a part, so that no row holds all of a large node's."""
        parts = self.counts().select("node_id", F.greatest(F.ceil(F.col("source_count") / size), F.lit(1)).cast("int").alias("parts"))
        placed = self.sources().join(parts, "node_id").withColumn("part", F.pmod(F.xxhash64("source"), F.col("parts")).cast("int"))
        listed = F.array_sort(F.collect_list(F.struct(F.col("source").alias("internal_source_id"), F.col("source_id").alias("external_source_id"))))
        return placed.groupBy("node_id", "part").agg(listed.alias("sources"))

    def node_lines(self, size: int = PART) -> DataFrame:
        """The fields of ``node_documents`` and part: a row without sources that says what a node is (part null), then its sources in rows that say only whose they are."""
        heads = self.nodes().select("node_id", "hkt_id", "words", F.array().cast(SOURCES).alias("sources"), "top_words", F.col("refuge").alias("is_refuge_node"), F.lit(None).cast("int").alias("part"))
        none = F.array().cast(WORDS)
        more = self.source_parts(size).select("node_id", F.lit(None).cast("int").alias("hkt_id"), none.alias("words"), "sources", none.alias("top_words"), F.lit(None).cast("boolean").alias("is_refuge_node"), "part")
        return heads.unionByName(more)

    def hkt_documents(self) -> DataFrame:
        """The HKTs with the fields of an exported tree; a refuge's marker is one of the words."""
        s = self.state
        ids = materialise(self.legend(), "export-legend")
        listed = lambda df, name: df.groupBy("hkt_id").agg(F.array_sort(F.collect_set(F.struct("word_id", "token"))).alias(name))
        own = s.node_words.select("node_id", "token").join(ids, "token").join(s.nodes.select("node_id", "hkt_id"), "node_id").select("hkt_id", "word_id", "token")
        refuge = s.nodes.filter("refuge").select("hkt_id", F.lit(-1).alias("word_id"), F.lit(REFUGE).alias("token"))
        union = listed(own.unionByName(refuge), "all_node_words_union")
        rows = self.hkts().drop("expected_words", "words").join(listed(s.expected.join(ids, "token"), "expected_words"), "hkt_id", "left").join(union, "hkt_id", "left")
        return rows.select("hkt_id", "parent_node_id", _filled("expected_words", WORDS), _filled("all_node_words_union", WORDS), "node_ids", "is_state1")

    def source_documents(self) -> DataFrame:
        return self.registry.select(F.col("source").alias("internal_source_id"), F.col("source_id").alias("external_source_id"))

    def _removed(self) -> list[dict]:
        """What is left of HKTs that rebuilds replaced: their names, without a place in the tree."""
        none = {"expected_words": [], "all_node_words_union": [], "node_ids": []}
        return [{"hkt_id": k, "parent_node_id": -1, **none, "is_state1": self.rebuilt_from is not None and k >= self.rebuilt_from} for k in sorted(self.removed)]

    def plain(self) -> dict:
        """Ids only, as a document on the driver: for small trees."""
        tree = self.verbose()
        ids = lambda words: [w["word_id"] for w in words]
        hkt = lambda h: {"hkt_id": h["hkt_id"], "parent_node_id": h["parent_node_id"], "expected_words": ids(h["expected_words"]), "node_ids": h["node_ids"], "is_state1": h["is_state1"]}
        nodes = [
            {
                "node_id": n["node_id"], "hkt_id": n["hkt_id"], "word_ids": ids(n["words"]), "source_ids": [s["internal_source_id"] for s in n["sources"]],
                "top_words": ids(n["top_words"]), "is_refuge_node": n["is_refuge_node"],
            }
            for n in tree["nodes"]
        ]
        return {"hkts": [hkt(h) for h in tree["hkts"]], "nodes": nodes, "logically_removed_hkts": [hkt(h) for h in tree["logically_removed_hkts"]]}

    def verbose(self) -> dict:
        """Words and sources by name, with legends, as a document on the driver: for small trees."""
        rows = lambda df, key: [json.loads(r[0]) for r in df.orderBy(key).select(F.to_json(F.struct("*"))).collect()]
        return {
            "hkts": rows(self.hkt_documents(), "hkt_id"), "nodes": rows(self.node_documents(), "node_id"), "word_legend": rows(self.legend(), "word_id"),
            "source_legend": rows(self.source_documents(), "internal_source_id"), "logically_removed_hkts": self._removed(),
        }

    def write_json(self, path: str) -> None:
        """The same as JSON lines that the executors write: folders hkts, nodes (in parts), word_legend, source_legend."""
        for name, df in (("hkts", self.hkt_documents()), ("nodes", self.node_lines()), ("word_legend", self.legend()), ("source_legend", self.source_documents())):
            df.write.mode("overwrite").json(f"{path}/{name}")

    def _fragments(self, size: int) -> DataFrame:
        """section, a, b, text: pieces which in order are the exchange format's one document."""
        piece = lambda df, section, a, text, b=None: df.select(F.lit(section).alias("section"), a.cast("long").alias("a"), (F.lit(0) if b is None else b).cast("long").alias("b"), text.alias("text"))
        spark = self.state.nodes.sparkSession
        removed = json.dumps(self._removed(), ensure_ascii=False)
        marks = [(0, '{"hkts":['), (2, '],"nodes":['), (4, '],"word_legend":['), (6, '],"source_legend":['), (8, f'],"logically_removed_hkts":{removed}}}')]
        fixed = spark.createDataFrame([(s, 0, 0, t) for s, t in marks], "section int, a long, b long, text string")

        def listed(df: DataFrame, section: int, key: str) -> DataFrame:
            """A row each, with a comma before all but the first."""
            least = df.agg(F.min(key)).first()[0]
            return piece(df, section, F.col(key), F.concat(F.when(F.col(key) == F.lit(least), "").otherwise(","), F.to_json(F.struct(*df.columns))))

        nodes = self.nodes()
        least = nodes.agg(F.min("node_id")).first()[0]
        comma = F.when(F.col("node_id") == F.lit(least), "").otherwise(",")
        inner = lambda text: F.substring(text, F.lit(2), F.char_length(text) - 2)
        head = inner(F.to_json(F.struct("node_id", "hkt_id", "words")))
        tail = inner(F.to_json(F.struct("top_words", F.col("refuge").alias("is_refuge_node"))))
        opens = piece(nodes, 3, F.col("node_id"), F.concat(comma, F.lit("{"), head, F.lit(',"sources":[')))
        closes = piece(nodes, 3, F.col("node_id"), F.concat(F.lit("],"), tail, F.lit("}")), F.lit(1 << 40))
        parts = materialise(self.source_parts(size), "export-parts")
        first = parts.groupBy("node_id").agg(F.min("part").alias("first"))
        held = parts.join(first, "node_id")
        body = piece(held, 3, F.col("node_id"), F.concat(F.when(F.col("part") == F.col("first"), "").otherwise(","), inner(F.to_json("sources"))), F.col("part") + 1)
        rows = [fixed, listed(self.hkt_documents(), 1, "hkt_id"), opens, body, closes, listed(self.legend(), 5, "word_id"), listed(self.source_documents(), 7, "internal_source_id")]
        return functools.reduce(DataFrame.unionByName, rows)

    def write_document(self, path: str, size: int = PART) -> None:
        """The verbose tree as one JSON document at ``path``, which the driver puts together from files that the executors wrote, without holding it."""
        write_in_order(self._fragments(size), ["section", "a", "b"], path)

    def outline_rows(self) -> DataFrame:
        """place (array, in which order lines follow each other), text: a line for each HKT and node, sources as counts."""
        from driftgrove.operators.views import placed

        at = placed(self)
        names = F.array_join(F.transform("words", lambda w: F.coalesce(w["token"], F.concat(F.lit("#"), w["word_id"]))), ", ")
        mark = F.when(F.col("refuge"), F.lit(" [REFUGE]")).otherwise("")
        own = self.nodes().join(at.select("node_id", "place", "depth"), "node_id")
        text = F.concat(F.repeat(F.lit("  "), F.col("depth") * 2 + 1), F.lit("node "), "node_id", F.lit(": "), names, F.lit(" ("), "source_count", F.lit(" sources)"), mark)
        heads = at.select("hkt_id", "above", "depth").distinct()
        head = F.concat(F.repeat(F.lit("  "), F.col("depth") * 2), F.lit("HKT "), "hkt_id")
        return own.select("place", text.alias("text")).unionByName(heads.select("above", head.alias("text")).withColumnRenamed("above", "place"))

    def outline(self) -> str:
        """An indented listing of the tree, a line per HKT and node, on the driver."""
        return "\n".join(r["text"] for r in self.outline_rows().orderBy("place").collect())


def _filled(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind)).alias(c)


def tree_of(hkts: DataFrame, nodes: DataFrame, words: DataFrame, sources: DataFrame, removed: dict[int, int] | None = None) -> TreeExport:
    """A tree from rows in the exchange format, nodes in parts or whole. Which of a node's sources hold which word isn't part of it; such a tree is for browsing."""
    held = nodes.select("node_id", F.explode("sources").alias("s")).select("node_id", F.col("s.internal_source_id").alias("source"))
    nodes = nodes.filter("hkt_id IS NOT NULL")
    place = hkts.select("hkt_id", F.posexplode("node_ids").alias("ord", "node_id"))
    order = F.coalesce(F.col("ord"), F.row_number().over(Window.partitionBy("hkt_id").orderBy("node_id")) - 1)
    own = nodes.join(place, ["hkt_id", "node_id"], "left").select("node_id", "hkt_id", order.cast("int").alias("ord"), F.col("is_refuge_node").alias("refuge"))
    each = lambda c: nodes.select("node_id", F.posexplode(c).alias("rank", "w")).select("node_id", F.coalesce("w.token", F.concat(F.lit("#"), "w.word_id")).alias("token"), "w.word_id", F.col("rank").cast("int").alias("rank"))
    expected = hkts.select("hkt_id", F.explode("expected_words").alias("w")).select("hkt_id", "w.token")
    none = held.select("node_id", F.lit("").alias("token"), "source").limit(0)
    node_words = each("words").filter("word_id <> -1").select("node_id", "token", "word_id")
    state = State(hkts.select("hkt_id", "parent_node_id"), own, node_words, held, none, expected)
    registry = sources.select(F.col("external_source_id").alias("source_id"), F.col("internal_source_id").alias("source"))
    return TreeExport(state, words.select("word_id", "token"), each("top_words").select("node_id", "token", "rank"), registry, removed or {})


def read_tree(spark: SparkSession, path: str) -> TreeExport:
    """A tree from a file of the exchange format, one JSON document."""
    return whole_tree(spark.read.schema(TREE).option("multiLine", True).json(path))


def whole_tree(document: DataFrame) -> TreeExport:
    """A tree from a row with the exchange format's fields."""
    rows = lambda c: document.select(F.inline(c))
    removed = {r["hkt_id"]: r["parent_node_id"] for r in rows("logically_removed_hkts").select("hkt_id", "parent_node_id").collect()}  # one for each rebuild
    return tree_of(*[materialise(rows(c), f"tree-{c}") for c in ("hkts", "nodes", "word_legend", "source_legend")], removed)


def read_tree_lines(spark: SparkSession, path: str) -> TreeExport:
    """A tree from what ``write_json`` wrote."""
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    return tree_of(read("hkts", HKT), read("nodes", NODE), read("word_legend", "word_id int, token string"), read("source_legend", "internal_source_id bigint, external_source_id string"))
