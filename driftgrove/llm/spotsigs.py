"""Document fingerprints by SpotSigs, from DataFrame functions alone.

A spot signature is a common word (the anchor) and the next CHAIN content words after it; content
words are those that aren't anchors. A text's fingerprint is the sorted set of its signatures'
hashes. Fingerprints are compared by Jaccard likeness. A search partitions them by size, fetches
candidates by their rarest signatures, and prunes those whose sizes alone rule the threshold out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from driftgrove.llm.common import materialise

#: Common words of English, French, German and Spanish.
ANCHORS = tuple(
    "a an and are as at be by for from in is it of on that the this to was with "
    "au aux dans de des du en est et la le les que qui un une "
    "auf das dem den der die ein eine ist mit nicht und von zu "
    "como con del el las los no para por se su y".split()
)
CHAIN = 2
#: Hexadecimal digits of a signature's hash: 64 bits.
DIGITS = 16
#: Rows of a range of doc_ids, about, and the most ranges (their square root at each of two levels).
RANGE_ROWS, MAX_RANGES = 1024, 40_000


def normal(text: Column) -> Column:
    """Lower-cased runs of letters and digits, a space after each."""
    return F.ltrim(F.concat(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), F.lit(" ")))


def spots(text: Column) -> Column:
    """The content words of a text in order, each with the anchors before it: ``anchor anchor word``."""
    content = f"(?<![^ ])(?!(?:{'|'.join(ANCHORS)}) )([^ ]+) "
    pieces = F.split(F.regexp_replace(normal(text), content, "$1\n"), "\n")
    return F.slice(pieces, 1, F.size(pieces) - 1)


def add_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sorted distinct signature hashes of a text that isn't null.

    A text without any signature has one made of its words, or of itself if it has no words;
    the empty text has none.
    """
    digest = lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS)
    t, spot, chain = F.col(text), f"__spots_{name}", f"__chain_{name}"
    none = F.array().cast("array<string>")

    def own(s: Column, c: Column) -> Column:
        anchors = F.split(s, " ")
        each = F.transform(F.array_distinct(F.slice(anchors, 1, F.size(anchors) - 1)), lambda a: digest(F.concat(a, F.lit(" "), c)))
        return F.when(c.isNull() | ~s.contains(" "), none).otherwise(each)

    last = F.transform(spot, lambda s: F.substring_index(s, " ", -1))
    chained = last
    for k in range(1, CHAIN):
        chained = F.zip_with(chained, F.slice(last, k + 1, F.greatest(F.size(spot), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    words = F.regexp_replace(normal(t), " +", " ")
    whole = F.when(F.length(F.trim(words)) > 0, words).otherwise(t)
    found = f"__found_{name}"
    # a column for each step, or the steps before would run again for each element
    out = df.withColumn(spot, spots(t)).withColumn(chain, chained)
    out = out.withColumn(found, F.array_sort(F.array_distinct(F.flatten(F.zip_with(spot, chain, own)))))
    full = F.when(F.length(t) == 0, none).when(F.size(found) > 0, F.col(found)).otherwise(F.array(digest(whole)))
    return out.withColumn(name, F.when(t.isNotNull(), full)).drop(spot, chain, found)


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs, "")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets: 1 for two empty ones, 0 without an intersection when one is empty."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def size_part(n: Column, threshold: float) -> Column:
    """Number of the size range; sets in ranges that aren't the same or next to each other can't be alike."""
    return F.when(n == 0, -2).otherwise(F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)))).cast("int")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with signatures, fingerprint and n_chars (code points); a null text counts as empty."""
    out = add_signatures(docs.withColumn("__t", F.coalesce(F.col(text), F.lit(""))), "__t", "signatures")
    return out.withColumn("n_chars", F.char_length("__t").cast("long")).withColumn("fingerprint", fingerprint(F.col("signatures"))).drop("__t")


def fingerprint_classes(docs: DataFrame, chosen: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per distinct fingerprint: cls, first (the smallest id), members, wanted (of them ``chosen``), signatures, n."""
    rows = fingerprints(docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(chosen, F.lit(False)).alias("q"), F.col(f"`{text}`").alias("text")))
    keyed = rows.withColumn("cls", F.md5(F.col("fingerprint").cast("binary")))
    found = keyed.groupBy("cls").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members"), F.count_if("q").alias("wanted"), F.any_value("signatures").alias("signatures"))
    return found.withColumn("n", F.size("signatures"))


def least_common(n: Column, threshold: float) -> Column:
    """Signatures that a set of n shares at least with any set that is ``threshold`` alike."""
    return F.ceil(n * F.lit(threshold) - 1e-9).cast("int")


def search(docs: DataFrame, chosen: Column, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, n_queries, match_id, members, near: all fingerprints at least ``threshold`` like those of the ``chosen`` rows.

    Documents with equal fingerprints are one class, known by its smallest id; n_queries and members
    count the chosen documents of the one class and all documents of the other. A class matches
    itself (near 1). Empty fingerprints, those of empty and null texts, match nothing. Rows that
    repeat an id count each; a null id is passed over in naming a class.

    A query class looks for its rarest signatures, so many that a match can't lack all of them; they
    meet only sets in the same size range or a neighbouring one, of which nothing but class and size
    is in the join. Pairs whose sizes rule them out go, and what is left is compared in full.
    """
    classes = materialise(fingerprint_classes(docs, chosen, key, text).filter("n > 0"), "spotsigs-classes")
    queries = classes.filter("wanted > 0")
    own = queries.select("cls", "n", F.explode("signatures").alias("sig"))
    wanted = own.select("sig").distinct()
    held = classes.select(F.col("cls").alias("m"), F.col("n").alias("m_n"), F.explode("signatures").alias("sig"))
    common = held.select("sig").join(wanted, "sig", "left_semi").groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ordered = own.join(common, "sig").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s"))
    head = ordered.select("cls", "n", F.explode(F.slice("s", 1, F.col("n") - least_common(F.col("n"), threshold) + 1)).alias("h")).select("cls", "n", "h.sig")
    head = materialise(head, "spotsigs-head")
    part = size_part(F.col("n"), threshold)
    near_sizes = head.select("cls", "n", "sig", F.explode(F.array(part - 1, part, part + 1)).alias("part"))
    small, large = F.least("n", "m_n"), F.greatest("n", "m_n")
    met = held.withColumn("part", size_part(F.col("m_n"), threshold)).join(near_sizes, ["part", "sig"]).filter(small >= large * threshold - 1e-9)
    pairs = met.select("cls", "m").distinct()
    sides = pairs.join(queries.select("cls", F.col("first").alias("query_id"), F.col("wanted").alias("n_queries"), F.col("signatures").alias("a")), "cls")
    sides = sides.join(classes.select(F.col("cls").alias("m"), F.col("first").alias("match_id"), "members", F.col("signatures").alias("b")), "m")
    return sides.withColumn("near", jaccard(F.col("a"), F.col("b"))).filter(F.col("near") >= threshold).select("query_id", "n_queries", "match_id", "members", "near")


def ranges(docs: DataFrame, key: str = "doc_id", rows: int = RANGE_ROWS) -> DataFrame | None:
    """One row with ``begins``: ids that begin ranges of about ``rows`` rows each, in groups in order; None without ids."""
    known = docs.filter(F.col(key).isNotNull())
    n = known.count()
    if not n:
        return None
    parts = max(1, min(MAX_RANGES, n // rows))
    if isinstance(docs.schema[key].dataType, T.NumericType):
        found = known.agg(F.array_append(F.percentile_approx(key, [i / parts for i in range(parts)], max(10_000, 4 * parts)), F.min(key)).alias("at"))
    else:
        firsts = known.select(key).repartitionByRange(parts, key).groupBy(F.spark_partition_id()).agg(F.min(key).alias("at"))
        found = firsts.agg(F.collect_list("at").alias("at"))  # an id for each range
    step = max(1, math.isqrt(parts))
    at = F.array_sort(F.array_distinct("at"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(at) - 1) / step).cast("int")), lambda i: F.slice(at, i * step + 1, F.lit(step)))
    return materialise(found.select(groups.alias("begins"), F.size(at).alias("n_ranges"), F.lit(step).alias("step")), "spotsigs-ranges")


def with_next(docs: DataFrame) -> DataFrame:
    """id, t, next_t and the window's columns of each row and, where ``ghost``, of the row that begins the range after.

    Rows are dealt out by ranges of doc_id. The row that begins a range is also sent to the range
    before it (the first to the last), so that each row's next one is in its own range.
    """
    begins = ranges(docs)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    known = rows.filter("id IS NOT NULL")
    if begins is not None:
        known = known.join(F.broadcast(begins), F.lit(True))  # one row
        coarse = F.size(F.filter("begins", lambda g: F.get(g, F.lit(0)) <= F.col("id"))) - 1
        known = known.withColumn("coarse", coarse).withColumn("group", F.get("begins", F.col("coarse")))
        part = F.col("coarse") * F.col("step") + F.size(F.filter("group", lambda b: b <= F.col("id"))) - 1
        known = known.withColumn("part", part)
        own = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))
        before = F.struct(F.pmod(F.col("part") - 1, F.col("n_ranges")).alias("part"), F.lit(True).alias("ghost"))
        both = F.when(F.array_contains("group", F.col("id")), F.array(own, before)).otherwise(F.array(own))
        known = known.withColumn("at", F.explode(both)).select("id", "t", "at.part", "at.ghost")
    else:
        known = known.select("id", "t", F.lit(0).alias("part"), F.lit(False).alias("ghost"))
    unknown = rows.filter("id IS NULL").select("id", "t", (-1 - F.pmod(F.hash("t"), F.lit(1000))).alias("part"), F.lit(False).alias("ghost"))
    return known.unionByName(unknown).withColumn("tie", F.xxhash64("t"))


def edit_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures of every row.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as
    many, or all, of the next document by doc_id, the first one following the last. Null texts
    count as empty. Rows that repeat a doc_id follow each other by a hash of the text. A row with a
    null doc_id has no next document: the empty text stands for it.
    """
    order = Window.partitionBy("part").orderBy("ghost", "id", "tie")
    rows = with_next(docs)
    n = F.char_length("t")
    half = F.floor(n / 2).cast("int")
    following = F.when(F.col("id").isNull(), F.lit("")).otherwise(F.coalesce("next_t", F.lit("")))
    edited = F.concat(F.substring("t", F.lit(1), n - half), F.substring(following, F.lit(1), half))
    texts = rows.withColumn("next_t", F.lead("t").over(order)).select("part", "ghost", "id", "tie", "t", n.cast("long").alias("n_chars"), F.when(~F.col("ghost"), edited).alias("edited"))
    sets = add_signatures(add_signatures(texts, "t", "s"), "edited", "e").drop("t").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    both = sets.withColumn("x", F.lead("s").over(order)).filter("NOT ghost")
    after = F.when(F.col("id").isNull(), F.array().cast("array<string>")).otherwise(F.coalesce("x", F.array().cast("array<string>")))
    return both.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"),
        jaccard(F.col("s"), F.col("e")).alias("near_edited"), jaccard(F.col("s"), after).alias("near_next"), F.size("s").cast("long").alias("n_signatures"),
    )
