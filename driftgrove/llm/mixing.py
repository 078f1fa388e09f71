"""Mixing sources to target weights by Poisson replication.

A document of source s is wanted r(s) times on average, where r(s) is the source's target share of
the output over its share of the input. Its count is the inverse of the Poisson distribution with
mean r(s) at a number that hashes its id and the seed, so the same document always gets the same
count. Copies are exploded and dealt out by a hash of id and copy, sorted within each partition:
a global shuffle with one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrove.llm.common import id_text

#: Name of the class of all sources without a weight of their own.
OTHER = "*"
#: Weights are a parameter; so many at most are sent to all executors.
MAX_WEIGHTS = 10_000
#: Rows of the distributions' table up to which it is broadcast.
MAX_CELLS = 500_000


def uniform(key: Column) -> Column:
    """52 bits of the key's MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdf(rate: float) -> tuple[int, np.ndarray]:
    """(k, P(X <= k), P(X <= k + 1), ...): all that doubles can tell from 0 and 1, about 18 * sqrt(rate) numbers.

    Terms are taken relative to the likeliest one, so that no rate makes them vanish.
    """
    if rate <= 0:
        return 0, np.ones(1)
    wide = 9 * math.sqrt(rate) + 45
    k = np.arange(max(0, math.floor(rate - wide)), math.ceil(rate + wide) + 1)
    mode = math.floor(rate)
    up, down = k[k > mode], k[k < mode]
    logs = np.concatenate((np.cumsum(np.log((down + 1.0)[::-1] / rate))[::-1], np.zeros(1), np.cumsum(np.log(rate / up))))
    terms = np.exp(logs)
    return int(k[0]), np.minimum(np.cumsum(terms) / terms.sum(), 1.0)


def guide(rate: float) -> list[tuple[int, int, list[float]]]:
    """(cell, copies below it, the distribution's values within it) for equal cells of [0, 1), about four values to a cell."""
    first, cdf = poisson_cdf(rate)
    cells = 1 << max(0, (len(cdf) // 4).bit_length() - 1)
    at = np.minimum((cdf * cells).astype(np.int64), cells)
    ends = np.searchsorted(at, np.arange(cells + 1))
    return [(c, first + int(ends[c]), cdf[ends[c] : ends[c + 1]].tolist()) for c in range(cells)]


def source_class(source: Column, weights: Mapping[str, float]) -> Column:
    own = [w for w in weights if w != OTHER]
    return F.when(source.isin(*own), source).otherwise(F.lit(OTHER)) if own else F.lit(OTHER)


def rates(docs: DataFrame, weights: Mapping[str, float], epochs: float = 1.0) -> dict[str, float]:
    """Mean copies of a document, by source class. Weights are taken relative to their sum over classes that have documents."""
    if len(weights) > MAX_WEIGHTS or any(not 0 <= w < math.inf for w in weights.values()):
        raise ValueError(f"weights: {MAX_WEIGHTS} at most, finite and not negative")
    # as many rows as there are weights, and one
    counts = {r["c"]: r["n"] for r in docs.groupBy(source_class(F.col("source"), weights).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(weights.get(c, 0.0) for c in counts)
    return {c: weights.get(c, 0.0) / whole * epochs * sum(counts.values()) / n if whole else 0.0 for c, n in counts.items()}


def mix(docs: DataFrame, weights: Mapping[str, float], epochs: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """Columns of ``docs``, then rate, n_copies, copy_no (from 0) and shuffle_key, in random order.

    ``weights`` maps sources to shares of the output, ``"*"`` stands for all others and for null.
    Sources that neither covers get no copies; so do all if no weight is positive. Texts are
    not read. Rows that repeat a doc_id get the same count; a null doc_id hashes as the empty
    text. Input columns with the names of the new ones are replaced. A row finds its cell of the
    class's distribution in a table of about 18 * sqrt(rate) / 4 rows for each class, which is
    broadcast up to MAX_CELLS rows and joined by a shuffle beyond.
    """
    names = ["rate", "n_copies", "copy_no", "shuffle_key"]
    order = [c for c in docs.columns if c not in names] + names
    counted = counts(docs.drop(*names), weights, epochs, seed)
    copies = counted.filter("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.concat(F.lit(f"{seed}:"), id_text(F.col("doc_id")), F.lit(":"), F.col("copy_no").cast("string"))
    keyed = copies.withColumn("shuffle_key", F.md5(key.cast("binary")))
    return keyed.select(*[F.col(f"`{c}`") for c in order]).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def counts(docs: DataFrame, weights: Mapping[str, float], epochs: float = 1.0, seed: str = "mix-1", found: Mapping[str, float] | None = None) -> DataFrame:
    """``docs`` with rate and n_copies. ``found``: the rates by source class, by default those of ``rates``."""
    spark = docs.sparkSession
    found = rates(docs, weights, epochs) if found is None else found
    tables = {c: guide(r) for c, r in found.items()}
    by_class = spark.createDataFrame([(c, r, float(len(tables[c]))) for c, r in found.items()], "__class string, rate double, __cells double")
    cells = spark.createDataFrame([(c, *row) for c, t in tables.items() for row in t], "__class string, __cell int, __below int, __cdf array<double>")
    if sum(map(len, tables.values())) <= MAX_CELLS:
        cells = F.broadcast(cells)
    u = uniform(F.concat(F.lit(f"{seed}:"), id_text(F.col("doc_id"))))
    placed = docs.withColumn("__class", source_class(F.col("source"), weights)).join(F.broadcast(by_class), "__class").withColumn("__u", u)  # MAX_WEIGHTS rows
    placed = placed.withColumn("__cell", F.floor(F.col("__u") * F.col("__cells")).cast("int")).join(cells, ["__class", "__cell"])
    n = F.col("__below") + F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))
    return placed.withColumn("n_copies", n.cast("int")).drop("__class", "__cells", "__cell", "__below", "__cdf", "__u")
