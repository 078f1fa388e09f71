"""Building the tree of clusters, level by level.

A scope is a set of postings (source, word). Its frequent words are dealt out to nodes one after
the other, by how much of a node's sources a word covers; that fold needs only how many sources
hold which set of frequent words, so each scope is aggregated to such patterns before it, and where
even these are many the fold goes some words at a time over the distributed patterns. Nodes
with enough sources open a scope of their own. Scopes of one level are handled together, and the whole
subtree of a small scope within one task. Different ways down often lead to the same postings: such a
scope is built once, and what is below it is repeated only when the tree is read out by path.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from driftgrove.config import BuilderConfig
from driftgrove.operators.postings import earliest
from driftgrove.tables import materialise, numbered

#: Postings up to which a scope's subtree is built in one task.
SMALL = 50_000
#: Distinct sets of frequent words up to which a scope is folded in one task.
WIDE = 200_000
#: Rows that are broadcast at most.
FEW = 500_000
TOP_WORDS = 10
REFUGE = -1
#: The id of the first scope.
ROOT = "root"
#: Nodes of a tree up to which the driver numbers them.
PLACES = 20_000
#: Frequent words of a wide scope that are folded together, and the most signatures that the driver takes for it.
BLOCK, SIGNATURES = 32, 100_000
#: Sources and pairs of nodes that a task gathers before it hands them on.
OUT = 200_000


def fold(rows: list[np.ndarray], counts: np.ndarray, first: int, order: Iterable[int], similarity: float) -> list[list[int]]:
    """Words of each node. ``rows``: the sets of sources that hold each word, ``counts``: how many sources a set stands for.

    ``first`` seeds the first node and the words of ``order`` follow: each joins the node of whose
    sources it covers the largest share, the earliest on ties, if that is ``similarity`` or more.
    Only nodes that share a source with the word are looked at.
    """
    weight = counts.tolist()
    nodes: list[list[int]] = []
    held: list[int] = []
    of_row: list[list[int]] = [[] for _ in weight]

    def put(w: int, node: int) -> None:
        if node == len(nodes):
            nodes.append([])
            held.append(0)
        nodes[node].append(w)
        for r in rows[w].tolist():
            if node not in of_row[r]:
                of_row[r].append(node)
                held[node] += weight[r]

    put(first, 0)
    for w in order:
        common: dict[int, int] = {}
        for r in rows[w].tolist():
            for n in of_row[r]:
                common[n] = common.get(n, 0) + weight[r]
        best, at = -1.0, len(nodes)
        for n, c in common.items():
            share = c / held[n]
            if share >= similarity and (share > best or share == best and n < at):
                best, at = share, n
        put(w, 0 if not common and similarity <= 0 else at)
    return nodes


NODE = "scope string, ord int, refuge boolean, words array<int>, top array<int>, expected array<int>, sources array<long>, pairs array<struct<word:int,source:long>>, child string"


def subtree(root: str, source: np.ndarray, word: np.ndarray, at: np.ndarray, config: BuilderConfig, arrival: bool = False) -> Iterator[dict]:
    """A row per node of the scope and of all distinct scopes below it. ``at``: places in order of arrival; ``arrival``: the scope itself is in that order (see ``build``).

    A scope below is known by the places of its postings among those of ``root``; one that comes again is
    referred to, not built again.
    """
    ids: dict[bytes, str] = {}
    todo = [(root, np.arange(len(source), dtype=np.int32))]
    while todo:
        scope, held = todo.pop()
        own_source, own_word, own_at = source[held], word[held], at[held]
        words, wi = np.unique(own_word, return_inverse=True)
        df = np.bincount(wi)
        first_at = np.full(len(words), np.iinfo(np.int64).max)
        np.minimum.at(first_at, wi, own_at)
        by = np.lexsort((first_at, -df))
        if arrival:
            line = wi[np.argsort(own_at, kind="stable")]
            by = line[:1]
            low = df[line] / df[by[0]] < config.minimum_threshold_against_max_word_count
            expected = np.unique(line[: int(low.argmax()) if low.any() else len(line)])
            arrival = False
        else:
            expected = np.flatnonzero(df / df[by[0]] >= config.minimum_threshold_against_max_word_count)
        sources, si = np.unique(own_source, return_inverse=True)
        hit = np.isin(wi, expected)
        column = np.full(len(words), -1)
        column[expected] = np.arange(len(expected))
        by_word = np.argsort(column[wi[hit]], kind="stable")
        rows = np.split(si[hit][by_word], np.cumsum(df[expected])[:-1])
        seed = int(column[by[0]])
        nodes = fold(rows, np.ones(len(sources), np.int64), seed, [c for c in range(len(expected)) if c != seed], config.similarity_threshold)
        members = []
        for n in nodes:
            mask = np.zeros(len(sources), bool)
            mask[np.concatenate([rows[c] for c in n])] = True
            members.append((sorted(expected[n].tolist()), mask))
        left = ~np.logical_or.reduce([m for _, m in members])
        if left.any():
            members.append(([], left))
        children = []
        for k, (own, mask) in enumerate(members):
            refuge = not own
            inside = mask[si]
            below = inside & ~np.isin(wi, own)
            grows = mask.sum() > config.minimum_number_of_sources_to_create_branch_for_node and below.any()
            top: list[int] = []
            child = None
            if grows:
                places = held[below]
                digest = hashlib.blake2b(places.tobytes(), digest_size=16).digest()
                if (child := ids.get(digest)) is None:
                    child = ids[digest] = f"{root}/{len(ids)}"
                    children.append((child, places))
            if grows and not refuge:
                bw, bi = np.unique(wi[below], return_inverse=True)
                b_df, b_at = np.bincount(bi), np.full(len(bw), np.iinfo(np.int64).max)
                np.minimum.at(b_at, bi, own_at[below])
                top = words[own].tolist() + words[bw[np.lexsort((b_at, -b_df))]].tolist()[: max(0, TOP_WORDS - len(own))]
            pair = inside & ~below
            yield {
                "scope": scope, "ord": k, "refuge": refuge, "words": [REFUGE] if refuge else words[own].tolist(), "top": top,
                "expected": words[np.setdiff1d(expected, by[:1])].tolist() if k == 0 else [], "sources": sources[mask].tolist(),
                "pairs": [] if refuge else [{"word": w, "source": x} for w, x in zip(own_word[pair].tolist(), own_source[pair].tolist(), strict=True)], "child": child,
            }
        todo += reversed(children)


def finished(scopes: DataFrame, config: BuilderConfig, arrival: bool) -> DataFrame:
    """NODE rows of small scopes and all below them; a task holds one of the given scopes at a time and a part of its nodes."""
    held = scopes.select("scope", "source", "word", "first", "nth")

    def nodes(scope: str, parts: list[pa.RecordBatch]) -> Iterator[dict]:
        source, word, first, nth = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(1, 5))
        at = np.empty(len(first), np.int64)
        at[np.lexsort((nth, first))] = np.arange(len(first))
        yield from subtree(scope, source, word, at, config, arrival)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("scope", pa.string()), ("ord", pa.int32()), ("refuge", pa.bool_()), *[(c, pa.list_(pa.int32())) for c in ("words", "top", "expected")], ("sources", pa.list_(pa.int64())),
            ("pairs", pa.list_(pa.struct([("word", pa.int32()), ("source", pa.int64())]))), ("child", pa.string())])
        scope, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for n in nodes(scope, parts) if parts else ():
                rows.append(n)
                size += len(n["sources"]) + len(n["pairs"])
                if size >= OUT:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

        for b in batches:
            ids = b.column(0)
            cuts = [0, *(np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for x, y in itertools.pairwise(cuts):
                own = ids[x].as_py()
                if own != scope:
                    yield from done()
                    scope, parts = own, []
                parts.append(b.slice(x, y - x))
        yield from done()

    # a fixed number of tasks: little data may mean much work here
    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.repartition(n, "scope").sortWithinPartitions("scope").mapInArrow(run, NODE)


@dataclass(frozen=True)
class Tree:
    """The tables of a tree version. Scopes that are equal are built and kept once; the tables by node_id are joined from them when read."""

    scopes: DataFrame  # hkt_id, path, scope
    nodes: DataFrame  # node_id, hkt_id, ord, refuge, scope
    node_words: DataFrame  # node_id, word_id
    node_sources: DataFrame  # node_id, source
    word_sources: DataFrame  # node_id, word_id, source
    expected: DataFrame  # hkt_id, word_id
    top_words: DataFrame  # node_id, word_id, rank
    hkts: DataFrame  # hkt_id, parent_node_id


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has no more than FEW rows."""
    return F.broadcast(df) if rows <= FEW else df


def _level(scope: DataFrame, scopes: int, config: BuilderConfig, arrival: bool = False, wide: int = WIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes: scope, ord, word; held: scope, ord, refuge, source, own, rest; expected: scope, word, df, seed) of all given scopes.

    ``scope``: scope, source, posts, a row per source. ``own`` are its words that are in the node, ``rest`` its other
    postings. Everything about a scope is an aggregate of its sources; no task gets a whole scope, but the
    ``wide`` distinct sets of frequent words that a scope may have to be folded in one go, and no source is exchanged.
    """
    least = config.minimum_threshold_against_max_word_count
    words = materialise(posts_of(scope).groupBy("scope", "word").agg(F.count(F.lit(1)).alias("df"), *earliest()), "tree-words")
    at = F.struct("first", "nth")
    first = at if arrival else F.struct((-F.col("df")).alias("d"), "first", "nth")
    lead = few(words.groupBy("scope").agg(F.min_by(F.struct("word", "df"), first).alias("lead")), scopes)
    line = words.join(lead, "scope").withColumn("ok", F.col("df") / F.col("lead.df") >= least)
    if arrival:
        stop = few(line.filter("NOT ok").groupBy("scope").agg(F.min(at).alias("stop")), scopes)
        line = line.join(stop, "scope", "left").withColumn("ok", F.col("stop").isNull() | (at < F.col("stop")))
    expected = materialise(line.filter("ok").select("scope", "word", "df", (F.col("word") == F.col("lead.word")).alias("seed")), "tree-expected")
    n = expected.count()
    line = few(expected.groupBy("scope").agg(F.collect_list("word").alias("__line")), n)
    pattern = F.array_sort(F.array_intersect(F.transform("posts", lambda p: p["word"]), "__line"))
    met = scope.join(line, "scope").select("scope", "source", "posts", pattern.alias("pattern"))
    held = materialise(met.filter(F.size("pattern") > 0).groupBy("scope", "pattern").agg(F.count(F.lit(1)).alias("n")), "tree-patterns")
    sizes = held.groupBy("scope").agg(F.count(F.lit(1)).alias("patterns")).filter(F.col("patterns") > wide).select("scope")
    if not sizes.isEmpty():
        big = few(sizes, scopes)
        folded = fold_by_steps(held.join(big, "scope", "left_semi"), expected.join(big, "scope", "left_semi"), config.similarity_threshold)
        nodes = folded.unionByName(fold_by_scope(held.join(big, "scope", "left_anti"), expected, config.similarity_threshold))
    else:
        nodes = fold_by_scope(held, expected, config.similarity_threshold)
    nodes = materialise(nodes, "tree-nodes")
    entries = F.map_from_entries(F.collect_list(F.struct("word", "ord")))
    node_of = few(nodes.groupBy("scope").agg(entries.alias("__node_of"), (F.max("ord") + 1).cast("int").alias("__last")), n)
    ords = F.transform("pattern", lambda w: F.element_at("__node_of", w))
    placed = met.join(node_of, "scope").withColumn("__ords", ords).withColumn("refuge", F.size("pattern") == 0)
    placed = placed.withColumn("ord", F.explode(F.when(F.col("refuge"), F.array("__last")).otherwise(F.array_distinct("__ords"))))
    own = F.transform(F.filter(F.arrays_zip("pattern", "__ords"), lambda x: x["__ords"] == F.col("ord")), lambda x: x["pattern"])
    placed = placed.withColumn("own", own)
    rest = F.filter("posts", lambda p: ~F.array_contains("own", p["word"]))
    return nodes, materialise(placed.select("scope", "ord", "refuge", "source", "own", rest.alias("rest")), "tree-held"), expected


def posts_of(scope: DataFrame) -> DataFrame:
    """scope, source, word, first, nth of scopes with a row per source."""
    return scope.select("scope", "source", F.explode("posts").alias("p")).select("scope", "source", "p.word", "p.first", "p.nth")


def fold_by_scope(patterns: DataFrame, expected: DataFrame, similarity: float) -> DataFrame:
    """scope, ord, word: the nodes of each scope, folded in one task from its patterns (scope, pattern, n)."""
    seeds = expected.filter("seed").select("scope", F.col("word").alias("seed"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        known = sorted({w for p in rows["pattern"] for w in p})
        place = {w: i for i, w in enumerate(known)}
        held: list[list[int]] = [[] for _ in known]
        for i, p in enumerate(rows["pattern"]):
            for w in p:
                held[place[w]].append(i)
        seed = place[int(rows["seed"].iloc[0])]
        nodes = fold([np.array(x) for x in held], rows["n"].to_numpy(), seed, [i for i in range(len(known)) if i != seed], similarity)
        scope = rows["scope"].iloc[0]
        return pd.DataFrame([(scope, k, known[w]) for k, n in enumerate(nodes) for w in n], columns=["scope", "ord", "word"])

    return patterns.join(seeds, "scope").groupBy("scope").applyInPandas(one, "scope string, ord int, word int")


def fold_by_steps(patterns: DataFrame, expected: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """The same, ``block`` words of every scope at a time, for scopes whose patterns no task could hold.

    What a block's words do to each other depends only on which nodes and which of these words a source has.
    Spark counts the sources of each such signature, and the driver folds the block over them. Where
    there are more than SIGNATURES of them the block is halved, and a single word needs no more
    than its common sources with each node. About a job for each ``block`` words of the widest scope.
    """
    spark = patterns.sparkSession
    lines: dict[str, list[tuple[int, int]]] = {}
    for r in expected.orderBy(F.desc("seed"), "word").collect():  # the frequent words of some scopes
        lines.setdefault(r["scope"], []).append((r["word"], r["df"]))
    node_of: dict[str, dict[int, int]] = {p: {line[0][0]: 0} for p, line in lines.items()}
    held: dict[str, list[int]] = {p: [line[0][1]] for p, line in lines.items()}
    i = 1
    while i < max(map(len, lines.values())):
        now = {p: line[i : i + block] for p, line in lines.items() if i < len(line)}
        found = signatures(patterns, {p: ([w for w, _ in words], node_of[p]) for p, words in now.items()}, alone=block == 1)
        if found is None:
            block //= 2
            continue
        for p, words in now.items():
            seen = found.get(p, [])
            for word, df in words:
                own = [s for s in seen if word in s[1]]
                common = [0] * len(held[p])
                for nodes, _, n in own:
                    for k in nodes:
                        common[k] += n
                shares = [c / n for c, n in zip(common, held[p], strict=True)]
                best = max(shares)
                k = shares.index(best) if best >= similarity else len(shares)
                if k == len(shares):
                    held[p].append(0)
                    common.append(0)
                node_of[p][word] = k
                held[p][k] += df - common[k]
                for nodes, _, _ in own:
                    nodes.add(k)
        i += block
    out = [(p, k, w) for p, words in node_of.items() for w, k in words.items()]
    return spark.createDataFrame(out, "scope string, ord int, word int")


def signatures(patterns: DataFrame, now: dict[str, tuple[list[int], dict[int, int]]], alone: bool) -> dict[str, list[tuple[set[int], set[int], int]]] | None:
    """By scope: (nodes, words, n), how many sources are in just these nodes and have just these of the given words; None if there are too many.

    ``now``: the words, and the node of each word before. ``alone``: there is one word to a scope, and the nodes may be told one by one.
    """
    rows = [(p, words, nodes) for p, (words, nodes) in now.items()]
    step = F.broadcast(patterns.sparkSession.createDataFrame(rows, "scope string, words array<int>, node_of map<int,int>"))  # a row per wide scope
    met = F.array_sort(F.array_intersect("pattern", "words"))
    at = F.array_sort(F.array_distinct(F.array_compact(F.transform("pattern", lambda w: F.try_element_at("node_of", w)))))
    inside = patterns.join(step, "scope").select("scope", "n", met.alias("met"), at.alias("at")).filter(F.size("met") > 0)
    found: dict[str, list[tuple[set[int], set[int], int]]] = {}
    if alone:  # a row per node
        for r in inside.select("scope", "met", "n", F.explode("at").alias("k")).groupBy("scope", "met", "k").agg(F.sum("n").alias("n")).collect():
            found.setdefault(r["scope"], []).append(({r["k"]}, set(r["met"]), r["n"]))
        return found
    counted = inside.groupBy("scope", "at", "met").agg(F.sum("n").alias("n")).limit(SIGNATURES + 1).collect()
    if len(counted) > SIGNATURES:
        return None
    for r in counted:
        found.setdefault(r["scope"], []).append((set(r["at"]), set(r["met"]), r["n"]))
    return found


def build(postings: DataFrame, config: BuilderConfig, small: int = SMALL, arrival: bool = False, wide: int = WIDE, places: int = PLACES, roots: Sequence[str] = (ROOT,)) -> Tree:
    """The tree over postings (source long, word int, first long, nth int), each source and word once with its first arrival.

    A forest grows at once from postings that also have the scope, one of ``roots``, in whose order its HKTs and nodes are numbered.

    Scopes of more than ``small`` postings go through Spark a level at a time; each smaller one is
    finished by a single task; ``wide`` bounds what a task folds of a large one. With ``arrival`` a root's postings aren't ranked: its seed is the
    first word to arrive, and its expected words end where a posting's df is first too small.

    What is below a node depends on its sources and on the words removed above alone, in whatever order
    they were. Scopes are therefore known by a 128-bit digest of their postings, and of equal ones, of
    this or an earlier level, only one is gone into.
    """
    spark = postings.sparkSession
    scopes = F.col("scope") if "scope" in postings.columns else F.lit(ROOT)
    root = postings.select(scopes.alias("scope"), F.col("source").cast("long").alias("source"), F.col("word").cast("int").alias("word"), F.col("first").cast("long").alias("first"), F.col("nth").cast("int").alias("nth"))
    # a row per source from here on: a scope below has its sources with fewer words, and nothing need bring them together again
    scope = materialise(root.groupBy("scope", "source").agg(F.collect_list(F.struct("word", "first", "nth")).alias("posts")), "tree-scope")
    sizes = scope.groupBy("scope").agg(F.sum(F.size("posts")).alias("n"))
    parts: dict[str, list[DataFrame]] = {k: [] for k in ("nodes", "words", "sources", "pairs", "expected", "top", "edges")}
    local: list[DataFrame] = []
    known: list[DataFrame] = []
    while True:
        counts = sizes.agg(F.count_if(F.col("n") <= small).alias("few"), F.count_if(F.col("n") > small).alias("many")).first()
        of_size = lambda keep, n: scope.join(few(sizes.filter(keep).select("scope"), n), "scope", "left_semi")  # noqa: B023, E731
        if counts["few"]:
            local.append(finished(posts_of(of_size(F.col("n") <= small, counts["few"]) if counts["many"] else scope), config, arrival))
        if not counts["many"]:
            break
        large = of_size(F.col("n") > small, counts["many"]) if counts["few"] else scope
        nodes, held, expected = _level(large, counts["many"], config, arrival, wide)
        arrival = False
        # of a node's sources and of what is below it, a digest, the same whatever their order
        digest = lambda of: F.hex(F.bit_xor(F.aggregate("rest", F.lit(0).cast("long"), lambda a, p: a.bitwiseXOR(of(p["word"])))))
        child = F.concat_ws("-", digest(lambda w: F.xxhash64("source", w)), digest(lambda w: F.xxhash64(w, "source", F.lit("b"))), F.sum(F.size("rest")))
        of_nodes = materialise(held.groupBy("scope", "ord", "refuge").agg(F.count(F.lit(1)).alias("sources"), F.sum(F.size("rest")).alias("n"), child.alias("child")), "tree-edges")
        parts["nodes"].append(of_nodes.select("scope", "ord", "refuge"))
        parts["words"].append(nodes.select("scope", "ord", "word").unionByName(of_nodes.filter("refuge").select("scope", "ord", F.lit(REFUGE).alias("word"))))
        parts["sources"].append(held.select("scope", "ord", "source"))
        parts["pairs"].append(held.select("scope", "ord", F.explode("own").alias("word"), "source"))
        parts["expected"].append(expected.filter("NOT seed").select("scope", "word"))
        edges = of_nodes.filter((F.col("sources") > config.minimum_number_of_sources_to_create_branch_for_node) & (F.col("n") > 0)).select("scope", "ord", "n", "child")
        grow = held.withColumnRenamed("rest", "posts").filter(F.size("posts") > 0)
        below = grow.join(edges.select("scope", "ord"), ["scope", "ord"]).select("scope", "ord", "source", F.explode("posts").alias("p")).select("scope", "ord", "source", "p.word", "p.first", "p.nth")
        parts["top"].append(_top_words(below, nodes))
        parts["edges"].append(edges.select("scope", "ord", "child"))
        fresh = edges.join(_union(known), "child", "left_anti") if known else edges
        chosen = materialise(fresh.groupBy("child").agg(F.min(F.struct("scope", "ord")).alias("of"), F.any_value("n").alias("n")).select("child", "of.scope", "of.ord", "n"), "tree-chosen")
        known.append(chosen.select("child"))
        sizes = chosen.select(F.col("child").alias("scope"), "n")
        scope = grow.join(few(chosen.select("child", "scope", "ord"), chosen.count()), ["scope", "ord"]).select(F.col("child").alias("scope"), "source", "posts")
    if local:
        held = materialise(_union(local), "tree-local")
        parts["nodes"].append(held.select("scope", "ord", "refuge"))
        parts["words"].append(held.select("scope", "ord", F.explode("words").alias("word")))
        parts["sources"].append(held.select("scope", "ord", F.explode("sources").alias("source")))
        parts["pairs"].append(held.select("scope", "ord", F.explode("pairs").alias("p")).select("scope", "ord", "p.word", "p.source"))
        parts["expected"].append(held.select("scope", F.explode("expected").alias("word")))
        parts["top"].append(held.select("scope", "ord", F.posexplode("top").alias("rank", "word")).select("scope", "ord", "word", F.col("rank").cast("int").alias("rank")))
        parts["edges"].append(held.filter("child IS NOT NULL").select("scope", "ord", "child"))
    schemas = {"nodes": "scope string, ord int, refuge boolean", "words": "scope string, ord int, word int", "sources": "scope string, ord int, source long", "pairs": "scope string, ord int, word int, source long", "expected": "scope string, word int", "top": "scope string, ord int, word int, rank int", "edges": "scope string, ord int, child string"}
    return _expanded({k: _union(v) if v else spark.createDataFrame([], schemas[k]) for k, v in parts.items()}, places, roots)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _top_words(below: DataFrame, nodes: DataFrame) -> DataFrame:
    """scope, ord, word, rank: a branching node's own words, then the first of those below it up to TOP_WORDS in all."""
    ranked = below.groupBy("scope", "ord", "word").agg(F.count(F.lit(1)).alias("df"), *earliest())
    place = F.row_number().over(Window.partitionBy("scope", "ord").orderBy(F.desc("df"), "first", "nth"))
    more = ranked.withColumn("r", place).filter(F.col("r") <= TOP_WORDS).select("scope", "ord", "word", "r")
    own = nodes.withColumn("r", (F.row_number().over(Window.partitionBy("scope", "ord").orderBy("word")) - 1).cast("int"))
    size = own.groupBy("scope", "ord").agg(F.count(F.lit(1)).cast("int").alias("size"))
    held = more.join(size, ["scope", "ord"])
    filled = held.filter(F.col("r") + F.col("size") <= TOP_WORDS).select("scope", "ord", "word", (F.col("r") + F.col("size") - 1).cast("int").alias("rank"))
    return own.join(held.select("scope", "ord").distinct(), ["scope", "ord"], "left_semi").select("scope", "ord", "word", F.col("r").alias("rank")).unionByName(filled)


def _paths(edges: DataFrame, roots: Sequence[str]) -> DataFrame:
    """path, scope: every place of the tree at which a scope stands, from the references, a level at a time; a path begins with the root's number."""
    at = edges.sparkSession.createDataFrame([([i], r) for i, r in enumerate(roots)], "path array<int>, scope string")
    found = [at]
    edges = materialise(edges, "tree-edges")
    while not (at := materialise(at.join(edges, "scope").select(F.concat("path", F.array("ord")).alias("path"), F.col("child").alias("scope")), "tree-paths")).isEmpty():
        found.append(at)
    return _union(found)


def _placed(parts: dict[str, DataFrame], roots: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hkt_id, path, scope; node_id, hkt_id, ord, refuge, scope; hkt_id, parent_node_id) by Spark, for trees of any size."""
    there = parts["nodes"].select("scope").distinct()
    placed = _paths(parts["edges"], roots).join(there, "scope", "left_semi")
    scopes = materialise(numbered(placed, ["path"], "hkt_id").select(F.col("hkt_id").cast("int").alias("hkt_id"), "path", "scope"), "tree-scopes")
    nodes = numbered(scopes.select("hkt_id", "scope").join(parts["nodes"], "scope"), ["hkt_id", "ord"], "node_id")
    nodes = materialise(nodes.select(F.col("node_id").cast("int").alias("node_id"), "hkt_id", "ord", "refuge", "scope"), "tree-nodes")
    above = scopes.filter(F.size("path") > 1).select("hkt_id", F.slice("path", 1, F.size("path") - 1).alias("path"), F.element_at("path", -1).alias("ord"))
    parent = above.join(scopes.select("path", F.col("hkt_id").alias("above")), "path").select("hkt_id", "ord", "above")
    parent = parent.join(nodes.select(F.col("hkt_id").alias("above"), "ord", F.col("node_id").alias("parent_node_id")), ["above", "ord"]).select("hkt_id", "parent_node_id")
    root = scopes.filter(F.size("path") == 1).select("hkt_id", F.lit(0).alias("parent_node_id"))
    return scopes, nodes, materialise(root.unionByName(parent), "tree-hkts")


def _placed_here(spark: SparkSession, nodes: list[Row], edges: list[Row], most: int, roots: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The same of a tree that is known to be small, without jobs; None if equal scopes stand in so many places that it isn't."""
    own: dict[str, list[tuple[int, bool]]] = {}
    for r in sorted(nodes, key=lambda r: r["ord"]):
        own.setdefault(r["scope"], []).append((r["ord"], r["refuge"]))
    child = {(r["scope"], r["ord"]): r["child"] for r in edges}
    scopes, rows, hkts = [], [], []
    todo = [((i,), r) for i, r in enumerate(roots) if r in own][::-1]
    while todo:
        path, scope = todo.pop()
        hkt = len(scopes) + 1
        scopes.append((hkt, list(path), scope))
        hkts.append((hkt, path[:-1], path[-1] if len(path) > 1 else None))
        below = []
        for ord_, refuge in own[scope]:
            rows.append((hkt, ord_, refuge, scope))
            if (scope, ord_) in child:
                below.append(((*path, ord_), child[scope, ord_]))
        if len(rows) > most:
            return None
        todo += reversed(below)
    number = {tuple(p): h for h, p, _ in scopes}
    node_of = {(r[0], r[1]): i + 1 for i, r in enumerate(rows)}
    links = [(h, node_of[number[above], ord_] if ord_ is not None else 0) for h, above, ord_ in hkts]
    made = [(i + 1, *r) for i, r in enumerate(rows)]
    return (
        spark.createDataFrame(scopes, "hkt_id int, path array<int>, scope string"),
        spark.createDataFrame(made, "node_id int, hkt_id int, ord int, refuge boolean, scope string"),
        spark.createDataFrame(links, "hkt_id int, parent_node_id int"),
    )


def _expanded(parts: dict[str, DataFrame], places: int, roots: Sequence[str]) -> Tree:
    """Ids by path: HKTs in preorder, nodes in order of their HKT and place, both from 1. A tree of up to ``places`` nodes is numbered by the driver."""
    spark = parts["nodes"].sparkSession
    found = None
    nodes = parts["nodes"].limit(places + 1).collect()  # bounded
    if len(nodes) <= places:
        found = _placed_here(spark, nodes, parts["edges"].collect(), places, roots)  # an edge per node at most
    scopes, nodes, hkts = found or _placed(parts, roots)
    ids = nodes.select("scope", "ord", "node_id")
    of = lambda k, *c: parts[k].join(ids, ["scope", "ord"]).select("node_id", *c)
    word = F.col("word").alias("word_id")
    expected = parts["expected"].join(scopes.select("scope", "hkt_id"), "scope").select("hkt_id", word)
    return Tree(scopes, nodes, of("words", word), of("sources", "source"), of("pairs", word, "source"), expected, of("top", word, "rank"), hkts)
