"""Tables for browsing a tree: the view of its nodes, sources per node, the treemap, filters and counts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from driftgrove.operators.export import TreeExport
from driftgrove.tables import materialise

SEPARATOR = " ▶ "
#: Tokens of a label, tokens that are shown, characters of a title, nodes that the explorer lists.
LABEL, SHOWN, TITLE, LISTED = 4, 10, 120, 250


def node_names(tree: TreeExport) -> DataFrame:
    """node_id, hkt_id, refuge, label, names (top words, else words), source_count."""
    names = F.transform(F.when(F.size("top_words") > 0, F.col("top_words")).otherwise(F.col("words")), lambda w: w["token"])
    rows = tree.nodes().withColumn("names", F.array_compact(names))
    label = F.when(F.size("names") > 0, F.array_join(F.slice("names", 1, LABEL), " ")).when(F.col("refuge"), F.lit("<refuge node>")).otherwise("(unnamed node)")
    return rows.select("node_id", "hkt_id", "refuge", label.alias("label"), "names", "source_count")


def keywords(tree: TreeExport) -> DataFrame:
    """hkt_id, keyword: its first expected word, else the first of its nodes' words, else its name."""
    return tree.hkts().select("hkt_id", F.coalesce(F.get("expected_words", F.lit(0)), F.get("words", F.lit(0)), F.concat(F.lit("HKT "), F.col("hkt_id"))).alias("keyword"))


def reached(tree: TreeExport) -> DataFrame:
    """node_id, parent_node_id, depth, category, path of the nodes that hang from a root, a level at a time.

    What a missing parent or a circle cuts off is never reached.
    """
    names = materialise(node_names(tree).select("node_id", "hkt_id", "label").join(tree.state.hkts, "hkt_id").join(keywords(tree), "hkt_id"), "views-names")
    front = names.filter("parent_node_id = 0").select("node_id", "parent_node_id", F.lit(0).alias("depth"), F.col("keyword").alias("category"), F.array("label").alias("path"))
    levels = []
    while True:
        front = materialise(front, "views-level")
        if not front.limit(1).count():
            break
        levels.append(front)
        above = front.select(F.col("node_id").alias("parent_node_id"), "depth", "category", F.col("path").alias("above"))
        front = names.join(above, "parent_node_id").select("node_id", "parent_node_id", (F.col("depth") + 1).alias("depth"), "category", F.concat("above", F.array("label")).alias("path"))
    return functools.reduce(DataFrame.unionByName, levels, front)


def placed(tree: TreeExport) -> DataFrame:
    """node_id, hkt_id, depth, above (the place of its HKT's line in an outline) and place (of its own), of the nodes that hang from a root.

    A place is the ids and orders on the way from the root: HKT, ord, HKT, ord and so on.
    """
    rows = materialise(tree.state.nodes.select("node_id", "hkt_id", "ord").join(tree.state.hkts, "hkt_id"), "views-placed")
    front = rows.filter("parent_node_id = 0").select("node_id", "hkt_id", F.lit(0).alias("depth"), F.array("hkt_id").alias("above"), F.array("hkt_id", "ord").alias("place"))
    levels = []
    while True:
        front = materialise(front, "views-level")
        if not front.limit(1).count():
            break
        levels.append(front)
        up = front.select(F.col("node_id").alias("parent_node_id"), "depth", F.col("place").alias("up"))
        front = rows.join(up, "parent_node_id").select("node_id", "hkt_id", (F.col("depth") + 1).alias("depth"), F.concat("up", F.array("hkt_id")).alias("above"), F.concat("up", F.array("hkt_id", "ord")).alias("place"))
    return functools.reduce(DataFrame.unionByName, levels, front)


def node_paths(tree: TreeExport) -> DataFrame:
    """node_id, path: labels from the root."""
    return reached(tree).select("node_id", F.array_join("path", SEPARATOR).alias("path"))


def tree_view(tree: TreeExport, source_ids: bool = False) -> DataFrame:
    """A row per node that hangs from a root, with what a treemap shows.

    ``source_ids``: with the names of all its sources in a row, for small trees.
    """
    names = materialise(node_names(tree), "views-nodes")
    most = names.agg(F.greatest(F.max("source_count"), F.lit(1)).alias("most"))
    value = F.greatest(F.col("source_count"), F.lit(1))
    rows = reached(tree).join(names, "node_id").join(F.broadcast(most), F.lit(True))  # one row
    same = [F.col("label").alias(c) for c in ("topic", "title", "source")]
    listed = F.lit("")
    if source_ids:
        rows = rows.join(tree.sources().groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("source", "source_id"))).alias("s")), "node_id", "left")
        listed = F.coalesce(F.array_join(F.transform("s", lambda s: s["source_id"]), ", "), F.lit(""))
    return rows.select(
        F.concat(F.lit("node:"), F.col("node_id")).alias("id"), F.when(F.col("parent_node_id") == 0, "").otherwise(F.concat(F.lit("node:"), F.col("parent_node_id"))).alias("parent"), "label", "node_id",
        "hkt_id", "depth", "source_count", "category", *same, F.lit("").alias("url"), F.current_date().alias("date"), value.alias("value"), (value / F.col("most")).alias("strength_pct"),
        listed.alias("source_ids"), F.array_join(F.slice("names", 1, SHOWN), ", ").alias("tokens"), F.col("refuge").alias("is_refuge_node"),
    )


def validation(tree: TreeExport) -> DataFrame:
    """One row: total_hkts, total_nodes, rendered_nodes, skipped_nodes."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = count(tree.state.hkts, "total_hkts").crossJoin(count(tree.state.nodes, "total_nodes")).crossJoin(count(reached(tree), "rendered_nodes"))  # one row each
    return rows.withColumn("skipped_nodes", F.col("total_nodes") - F.col("rendered_nodes"))


def source_assignments(tree: TreeExport, catalog: DataFrame) -> DataFrame:
    """source_id, hkt (root keyword), node_id, node_label, title, url of every source of every node."""
    rows = tree.sources().join(node_names(tree).select("node_id", F.col("label").alias("node_label")), "node_id").select("node_id", "node_label", "source_id")
    named = rows.join(reached(tree).select("node_id", F.col("category").alias("hkt")), "node_id").filter(F.length(F.trim("source_id")) > 0)
    return named.join(catalog, "source_id", "left").select("source_id", "hkt", "node_id", "node_label", F.coalesce(F.nullif("title", F.lit("")), "source_id").alias("title"), F.coalesce("url", F.lit("")).alias("url")).distinct()


def treemap(assignments: DataFrame) -> DataFrame:
    """id, parent, label, value, url, hkt: a row per keyword and one per source in it, the first by title."""
    one = assignments.groupBy("source_id", "hkt").agg(F.min_by(F.struct("title", "url"), F.struct("title", "node_id")).alias("x"))
    top = one.groupBy("hkt").agg(F.count(F.lit(1)).alias("value"))
    parents = top.select(F.concat(F.lit("hkt:"), "hkt").alias("id"), F.lit("").alias("parent"), F.col("hkt").alias("label"), "value", F.lit("").alias("url"), "hkt")
    leaves = one.select(
        F.concat(F.lit("src:"), "hkt", F.lit("::"), "source_id").alias("id"), F.concat(F.lit("hkt:"), "hkt").alias("parent"), F.substring("x.title", 1, TITLE).alias("label"),
        F.lit(1).cast("long").alias("value"), F.col("x.url").alias("url"), "hkt",
    )
    return parents.unionByName(leaves)


def subtree_filter(view: DataFrame, keyword: str | None = None, node_id: int | None = None) -> DataFrame:
    """The rows of a root keyword, and of those a node with all below it."""
    rows = view.filter(F.col("category") == keyword) if keyword else view
    if node_id is None:
        return rows
    parent = F.when(F.col("parent") != "", F.split_part("parent", F.lit(":"), F.lit(-1)).cast("int"))
    edges = materialise(rows.select("node_id", parent.alias("up")), "views-edges")
    found = front = materialise(edges.filter(F.col("node_id") == node_id).select("node_id"), "views-found")
    while front.limit(1).count():
        front = materialise(edges.join(front.withColumnRenamed("node_id", "up"), "up").select("node_id").join(found, "node_id", "left_anti"), "views-front")
        found = materialise(found.unionByName(front), "views-found")
    return rows.join(found, "node_id", "left_semi")


def assignment_filter(assignments: DataFrame, keyword: str | None = None, node_id: int | None = None) -> DataFrame:
    rows = assignments.filter(F.col("hkt") == keyword) if keyword else assignments
    return rows if node_id is None else rows.filter(F.col("node_id") == node_id)


def holds(columns: list[str], pattern: str) -> Column:
    """Any of the columns matches the regular expression, in either case; null doesn't."""
    return functools.reduce(Column.__or__, [F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False)) for c in columns])


def source_search(assignments: DataFrame, pattern: str = "", with_url: bool = False, by: str = "title", most: int = 50) -> DataFrame:
    """Sources for review: title or id match, one row each, sorted and at most ``most`` (a list on a screen)."""
    rows = assignments.filter(holds(["title", "source_id"], pattern)) if pattern else assignments
    rows = rows.filter(F.length(F.trim("url")) > 0) if with_url else rows
    first = F.row_number().over(Window.partitionBy("source_id").orderBy("title", "node_id"))
    return rows.withColumn("r", first).filter("r = 1").drop("r").orderBy(by, "source_id").limit(most)


def explorer(view: DataFrame, pattern: str = "", min_sources: int = 0, max_depth: int | None = None, most: int = LISTED) -> DataFrame:
    """Nodes that match, by depth, then sources downward, then label; at most ``most`` (a list on a screen)."""
    rows = view.filter(F.col("source_count") >= min_sources)
    rows = rows if max_depth is None else rows.filter(F.col("depth") <= max_depth)
    rows = rows.filter(holds(["label", "tokens"], pattern)) if pattern else rows
    return rows.orderBy("depth", F.desc("source_count"), "label", "node_id").limit(most)


def local_date(millis: Column, today: Column | None = None) -> Column:
    """The session's local date of a time in milliseconds since 1970; ``today`` (by default the current date) where it isn't a number above 0."""
    number = millis.cast("string").try_cast("double")
    return F.coalesce(F.when(number > 0, F.to_date(F.timestamp_millis(number.cast("long")))), F.current_date() if today is None else today)


def with_defaults(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``table`` with the missing ones of ``columns`` (name: SQL expression); value is a number, 1 where it isn't; date is a date or null."""
    out = table.withColumns({c: F.expr(e) for c, e in columns.items() if c not in table.columns})
    if "value" in out.columns:
        out = out.withColumn("value", F.coalesce(F.col("value").cast("string").try_cast("double"), F.lit(1.0)))
    return out.withColumn("date", F.try_to_date(F.col("date").cast("string"))) if "date" in out.columns else out
