"""From sources to postings, vocabularies and document frequencies."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from driftgrove.functions import text as tx
from driftgrove.tables import materialise, numbered


#: Scopes of which a row each is broadcast at most.
MAX_SCOPES = 500_000


def postings(sources: DataFrame) -> DataFrame:
    """A row per token occurrence: source_index, source_id, pos, token. Tokens are trimmed; empty ones go."""
    each = sources.select("source_index", "source_id", F.posexplode("tokens").alias("pos", "raw"))
    return each.select("source_index", "source_id", F.col("pos").cast("long").alias("pos"), tx.trim(F.col("raw")).alias("token")).filter(F.length("token") > 0)


def doc_tokens(sources: DataFrame, clean: bool = False) -> DataFrame:
    """source_index, source_id, token: each token of a source once, without a shuffle. ``clean``: the tokens are trimmed already."""
    held = F.col("tokens") if clean else F.transform("tokens", tx.trim)
    return sources.select("source_index", "source_id", F.explode(F.array_distinct(held)).alias("token")).filter(F.length("token") > 0)


def first_places(sources: DataFrame, clean: bool = False, keep: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """source_index, ``keep``, token and nth, its place among the source's distinct tokens in order of first occurrence.

    Postings arrive in order of source_index, then nth; the two are never packed into one number, so that
    any 64-bit source_index will do.
    """
    held = F.col("tokens") if clean else F.transform("tokens", tx.trim)
    each = sources.select(F.col("source_index").cast("long").alias("source_index"), *keep, F.posexplode(F.array_distinct(held)).alias("nth", "token"))
    return each.filter(F.length("token") > 0).select("source_index", *keep, "token", "nth")


def earliest(first: str = "first", nth: str = "nth") -> list[Column]:
    """Aggregates for the earliest arrival of a group: the least source_index, and the place in that source."""
    return [F.min(first).alias("first"), F.min_by(nth, first).alias("nth")]


def sent_again(sources: DataFrame) -> DataFrame:
    """source_id of the sources that come in several rows."""
    return sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("source_id")


def by_source(sources: DataFrame, rows: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` of the sources, each source and token once: only sources in several rows need ``merge``, all others no shuffle."""
    again = materialise(sent_again(sources), "sent-again")
    if not again.limit(1).count():
        return rows(sources)
    return rows(sources.join(again, "source_id", "left_anti")).unionByName(merge(rows(sources.join(again, "source_id", "left_semi"))))


def holding(sources: DataFrame, word: DataFrame) -> DataFrame:
    """The sources that hold the token of ``word``, a row or none: told before they are cut into rows of tokens. ``sources`` have clean tokens.

    Of a source in several rows all count, if one of them holds it; only these meet by a join.
    """
    named = sources.filter(F.col("source_index").isNotNull())
    has = named.join(F.broadcast(word.select(F.col("token").alias("__held"))), F.array_contains("tokens", F.col("__held"))).drop("__held")  # one row
    again = materialise(named.groupBy("source_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("source_index"), "held-again")
    if not again.limit(1).count():
        return has
    more = has.join(again, "source_index", "left_semi").select("source_index")
    return has.join(again, "source_index", "left_anti").unionByName(named.join(more, "source_index", "left_semi"))


def word_df(sources: DataFrame, clean: bool = False) -> DataFrame:
    """token, df: how many sources hold it."""
    each = by_source(sources, lambda s: doc_tokens(s, clean).select("source_id", "token"), DataFrame.distinct)
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def first_and_df(sources: DataFrame, clean: bool = False) -> DataFrame:
    """token, first, nth, df: where each token arrives first, and how many sources hold it."""
    merge = lambda r: r.groupBy("source_id", "token").agg(*earliest())
    each = by_source(sources, lambda s: first_places(s, clean).select("source_id", "token", F.col("source_index").alias("first"), "nth"), merge)
    return each.groupBy("token").agg(*earliest(), F.count(F.lit(1)).alias("df"))


def vocabulary(sources: DataFrame, clean: bool = False) -> DataFrame:
    """word_id (from 1, by first appearance), token, df."""
    return numbered(first_and_df(sources, clean), ["first", "nth"], "word_id").select(F.col("word_id").cast("int").alias("word_id"), "token", "df")


def ranked_words(sources: DataFrame, clean: bool = False) -> DataFrame:
    """token, df, first, nth, place: by df downward, then by first appearance."""
    return numbered(first_and_df(sources, clean), [F.desc("df"), F.asc("first"), F.asc("nth")], "place").select("token", "df", "first", "nth", "place")


def expected_words(sources: DataFrame, threshold: float, clean: bool = False) -> DataFrame:
    """token, df of the words whose df is at least ``threshold`` of the largest."""
    rows = word_df(sources, clean)
    most = rows.agg(F.max("df").alias("most"))
    return rows.join(F.broadcast(most), F.col("df") / F.col("most") >= F.lit(threshold)).select("token", "df")  # one row


def expected_prefix(rows: DataFrame, threshold: float) -> DataFrame:
    """scope, token of the rows (scope, first, nth, token, df) in order of arrival up to the first whose df over the first row's df is below the threshold.

    A scope's first row and its first miss are among the first arrivals of its tokens, so these alone are
    kept. They meet a row per scope by broadcast: a large scope isn't the key of an exchange, and no task
    sorts or sees a whole scope.
    """
    words = rows.filter("scope IS NOT NULL").groupBy("scope", "token", "df").agg(F.min(F.struct("first", "nth")).alias("at"))
    words = materialise(words, "prefix-words")
    few = lambda d, n: F.broadcast(d) if n <= MAX_SCOPES else d
    lead = materialise(words.groupBy("scope").agg(F.min_by("df", "at").alias("lead")), "prefix-lead")
    n = lead.count()
    missed = words.join(few(lead, n), "scope").filter(F.col("df") / F.col("lead") < threshold)
    stop = materialise(missed.groupBy("scope").agg(F.min("at").alias("stop")), "prefix-stop")
    kept = words.join(few(stop, n), "scope", "left").filter(F.col("stop").isNull() | (F.col("at") < F.col("stop")))
    return kept.select("scope", "token").distinct()


def seed_word(sources: DataFrame, clean: bool = False) -> DataFrame:
    """The word with the largest df, the first to appear on ties."""
    return first_and_df(sources, clean).agg(F.min_by("token", F.struct((-F.col("df")).alias("d"), "first", "nth")).alias("token"), F.max("df").alias("df")).filter("token IS NOT NULL")


def source_ids(sources: DataFrame, rounds: int = 8) -> DataFrame:
    """source_id and its 64-bit id; of ids with the same hash the first to arrive keeps it, the others hash their id with ``#n``."""
    rows = sources.groupBy("source_id").agg(F.min("source_index").alias("first")).withColumn("internal_id", tx.fnv1a_64(F.col("source_id"))).withColumn("n", F.lit(0))
    for k in range(1, rounds + 1):
        place = F.row_number().over(Window.partitionBy("internal_id").orderBy("n", "first"))
        clash = rows.withColumn("p", place)
        if not clash.filter("p > 1").limit(1).count():
            return rows.select("source_id", "internal_id")
        again = F.col("p") > 1
        rows = clash.select(
            "source_id", "first",
            F.when(again, tx.fnv1a_64(F.concat("source_id", F.lit(f"#{k}")))).otherwise(F.col("internal_id")).alias("internal_id"), F.when(again, F.lit(k)).otherwise(F.col("n")).alias("n"),
        )
    raise RuntimeError("source ids still clash")


def merged_words(summaries: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """token, first, nth over several batches, from what ``first_and_df`` found in each and by how much its indices are moved.

    A batch that expires is left out of the next merge; no batch is cut into words again.
    """
    moved = [s.select("token", (F.col("first") + F.lit(by)).alias("first"), "nth") for s, by in summaries]
    return functools.reduce(DataFrame.unionByName, moved).groupBy("token").agg(*earliest())


def known_new(batch: DataFrame, vocab: DataFrame, clean: bool = False, words: DataFrame | None = None) -> DataFrame:
    """token, df, known: the distinct tokens of a batch and whether the vocabulary has them. ``words``: token, df of the batch, where they are known."""
    rows = word_df(batch, clean) if words is None else words.select("token", "df")
    return rows.join(vocab.select("token", F.lit(True).alias("k")), "token", "left").select("token", "df", F.coalesce("k", F.lit(False)).alias("known"))


def batch_word_stats(batch: DataFrame, vocab: DataFrame, clean: bool = False, words: DataFrame | None = None) -> DataFrame:
    """One row: unique_words, known_words, new_words, max_df, sources."""
    rows = known_new(batch, vocab, clean, words)
    words = rows.agg(
        F.count(F.lit(1)).alias("unique_words"), F.count_if("known").alias("known_words"), F.coalesce(F.max("df"), F.lit(0)).alias("max_df"),
    ).withColumn("new_words", F.greatest(F.col("unique_words") - F.col("known_words"), F.lit(0)))
    return words.crossJoin(batch.agg(F.count(F.lit(1)).alias("sources"))).select("unique_words", "known_words", "new_words", "max_df", "sources")  # one row each


def batch_trigger_metrics(stats: DataFrame, alpha: float, beta: float, thresholds: tuple[float, float, float]) -> DataFrame:
    """alpha, beta and dominance of a batch, their errors and the reasons that exceed (alpha, beta, importance) thresholds."""
    some = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(0.0))
    rows = stats.select(some("known_words", "unique_words").alias("alpha_estimate"), some("new_words", "unique_words").alias("beta_estimate"), some("max_df", "sources").alias("word_importance_error"), "unique_words", "sources")
    live = (F.col("unique_words") > 0) & (F.col("sources") > 0)
    apart = lambda c, x: F.when(live, F.abs(F.col(c) - F.lit(x))).otherwise(F.lit(0.0))
    out = rows.withColumn("alpha_error", apart("alpha_estimate", alpha)).withColumn("beta_error", apart("beta_estimate", beta)).withColumn("word_importance_error", F.when(live, F.col("word_importance_error")).otherwise(0.0))
    names = ("alpha_error", "beta_error", "word_importance_error")
    reasons = F.array_compact(F.array(*[F.when(F.col(n) > F.lit(t), F.lit(n)) for n, t in zip(names, thresholds, strict=True)]))
    return out.withColumn("reasons", reasons).select("alpha_estimate", "beta_estimate", *names, F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") > 0).alias("triggered"))
