"""Spelling variants by anagram hashing, from DataFrame functions alone.

A word's key is the sum of the fifth powers of its letters' numbers, whatever their order. One letter
more, less or in place of another changes the key by that letter's power or by the difference of two,
so two words are candidates if taking one letter off one of them, or off each, leaves the same key.
Whether the letters also stand in the right order is then verified.

Most candidates are anagrams of each other in another order. As two near words also share the first
or the last half of what is left of them, that half is part of the join: a letter taken off the second
half goes with the first one, and the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrove.llm.common import id_text, materialise
from driftgrove.llm.url_rules import LOWER, UPPER

#: Runs of letters that words are taken from.
RUN = "[A-Za-zÀ-ÿ]+"
#: One run in so many, told by a hash, loses a letter.
SLIP = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Letters are a to z and the 64 code points from U+00C0.
POWER = 5


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id (as text), run: a row for each run of letters of each text; letters A to Z are lower-cased. A null text has none, a null id is the empty text."""
    lower = F.translate(F.col(f"`{text}`").cast("string"), UPPER, LOWER)
    return docs.select(id_text(F.col(f"`{key}`")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))


def slipped(rows: DataFrame) -> DataFrame:
    """``word``: each run, without its letter number h % length where SLIP divides h, the crc32 of ``id:run``."""
    hashed = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % SLIP == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the distinct words that are long and frequent enough."""
    long = words.filter(F.char_length("word") >= min_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    number = F.when(code < 0xC0, code - 96).otherwise(code - 0xC0 + 27)
    out = number
    for _ in range(POWER - 1):
        out = out * number
    return out


def reduced(words: DataFrame) -> DataFrame:
    """key, half, second, full, word, n: for each word its key, and its keys without one letter.

    ``full`` rows are the words themselves. ``half`` is a hash of the first (``second`` false) or second
    half of the letters that are left.
    """
    size = F.char_length("word")
    keyed = words.withColumn("size", size).withColumn("powers", F.transform(F.sequence(F.lit(1), size), lambda i: power(F.substring("word", i, F.lit(1)))))
    keyed = keyed.withColumn("whole", F.aggregate("powers", F.lit(0).cast("long"), lambda a, x: a + x))
    h, mid = F.floor((F.col("size") - 1) / 2).cast("int"), F.floor(F.col("size") / 2).cast("int")
    left = lambda n: F.substring("word", F.lit(1), n)
    right = lambda n: F.substring("word", n + 1, F.col("size"))
    row = lambda key, second, half, full: F.struct(key.alias("key"), F.xxhash64(F.lit(second), half).alias("half"), F.lit(second).alias("second"), F.lit(full).alias("full"))
    off = lambda letters, second, half: F.transform(F.array_distinct(letters), lambda p: row(F.col("whole") - p, second, half, False))
    each = F.concat(
        off(F.slice("powers", h + 1, F.col("size")), False, left(h)),
        F.when(h > 0, off(F.slice("powers", F.lit(1), F.greatest(h, F.lit(1))), True, right(h + 1))).otherwise(F.array().cast("array<struct<key:bigint,half:bigint,second:boolean,full:boolean>>")),
        F.array(row(F.col("whole"), False, left(mid), True), row(F.col("whole"), True, right(mid), True)),
    )
    return keyed.select("word", "n", F.explode(each).alias("r")).select("r.*", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of words that differ by one letter more, less or replaced, once each way.

    A pair is met in the first half if its words begin alike, else in the second, and under one key, as
    no two differences of fifth powers of letters' numbers are equal; so no pair comes twice.
    """
    rows = reduced(words)
    a, b = rows.filter("NOT full").alias("a"), rows.alias("b")
    size_a, size_b = F.char_length("a.word"), F.char_length("b.word")
    h = F.floor((size_a - 1) / 2).cast("int")
    begin = lambda w: F.substring(w, F.lit(1), h)
    once = F.when(F.col("b.full"), size_a == size_b + 1).otherwise((size_a == size_b) & (F.col("a.word") < F.col("b.word")))
    own = ~F.col("a.second") | (begin("a.word") != begin("b.word"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.half") == F.col("b.half")) & (F.col("a.second") == F.col("b.second")) & once & own)
    met = met.filter(F.levenshtein("a.word", "b.word", 1) == 1)
    way = lambda x, y: F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{x}.n").alias("n"), F.col(f"{y}.word").alias("near"), F.col(f"{y}.n").alias("near_n"))
    return met.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).select("p.*")


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): forms are followed until one has none; each round doubles the way. They never lead back, as each occurs at least twice as often as the one before."""
    at = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not at.filter("moved").isEmpty():
        # who can't go on is where they end; only the others meet the table again
        going, done = at.filter("moved"), at.filter("NOT moved")
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = going.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        at = materialise(done.unionByName(moved), "spelling-roots")
    return at.select("word", "root")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table (word, n) of distinct words.

    ``form`` is the near word of largest n, the first in code-point order on ties, if it occurs at least
    ``ratio`` times as often (1 isn't enough), else null. ``root`` is the end of the chain of forms, the word itself if it has
    none. Words are of the letters of RUN, lower-cased in A to Z; null words go. An empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("a form must occur at least twice as often")
    words = words.filter(F.col("word").isNotNull() & F.col("n").isNotNull())
    best = near_pairs(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    takes = -F.col("best.less") >= ratio * F.col("n")
    best = materialise(best.select("word", "n_near", F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")), "spelling-near")
    roots = last_forms(best.filter(F.col("form").isNotNull()))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the words of all texts.

    Null and empty texts have no words, a null id counts as the empty text in the hash, rows that repeat
    count each, other columns aren't read, and an empty table gives an empty result. A run of any
    length is one word.
    """
    return variants(materialise(vocabulary(slipped(runs(docs, key, text))), "spelling-words"))
