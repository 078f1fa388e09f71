"""Language ID with language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: each slot has one bit per language, in as many 64-bit
words as that takes, and the AND of an n-gram's slots has the bits of all languages that contain it. A text is decided
by each language's count of its n-grams, corrected for the false positives expected at the fill of
that language's slice. The n-grams are the letters of a text with their two neighbours, anything
but a letter counting as a space.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrove.llm.common import hash_share, map_text, materialise

#: Rows of a language that are learned from, about: those whose hashed id is low enough.
SAMPLE_ROWS = 3000
#: An n-gram belongs to a language if it makes up this share of the language's n-grams ...
MIN_SHARE = 2e-5
#: ... and this part of the share that it has in the language where it is most common.
MIN_RATIO = 0.1
#: Slots (a power of two) and hash functions of the filter.
SLOTS, HASHES = 1 << 18, 4
#: Code points that are handled at once.
PIECE = 1 << 18
UNKNOWN = "und"
#: Covers every run of letters; what bounds it is no letter, so the n-grams of a text are those of its words.
WORD = re.compile(r"[^\W\d_]+")
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_grams", T.LongType())]


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (numbers of texts, parts of them), a group having about PIECE code points; each part has its neighbour or a space at either end."""
    numbers, parts, size = [], [], 0
    for k, text in enumerate(texts):
        text = f" {(text or '').lower()} "
        for at in range(0, len(text) - 2, PIECE):
            numbers.append(k)
            parts.append(text[at : at + PIECE + 2])
            size += len(parts[-1])
            if size >= PIECE:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


def word_pieces(words: list[str]) -> Iterator[tuple[range | list[int], list[str]]]:
    """``pieces`` of words, as many together as PIECE has room for were all as long as the longest."""
    longest = max(map(len, words), default=0) + 2
    if longest > PIECE:
        yield from pieces(words)
        return
    step = PIECE // longest
    for at in range(0, len(words), step):
        some = words[at : at + step]
        yield range(at, at + len(some)), [f" {w.lower()} " for w in some]


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the packed n-gram around each letter, number of the part that it is in)."""
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    middle = letters()[code]
    code = np.where(middle, code, 32).astype(np.uint64)
    ends = np.cumsum([len(p) for p in parts])
    middle[ends - 1] = False
    middle[np.concatenate(([0], ends[:-1]))] = False
    at = np.flatnonzero(middle)
    packed = code[at - 1] | code[at] << np.uint64(21) | code[at + 1] << np.uint64(42)
    return packed, np.searchsorted(ends, at, side="right")


def slots(packed: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The slot of each n-gram under each hash function."""
    a = packed * np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(29)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    step = a >> np.uint64(32) | np.uint64(1)
    for _ in range(HASHES):
        yield ((a >> np.uint64(7)) & np.uint64(size - 1)).astype(np.int64)
        a = a + (step << np.uint64(7))


def bit(words: np.ndarray, i: int) -> np.ndarray:
    """Bit i of each row of words, 0 or 1."""
    return words[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)


@dataclass
class Filters:
    """``table``: a row of words per slot, bit i % 64 of word i // 64 standing for ``langs[i]``; ``false``: each language's rate of false positives."""

    langs: list[str]
    table: np.ndarray
    false: np.ndarray

    @classmethod
    def build(cls, langs: list[str], members: dict[int, int], size: int = SLOTS) -> Filters:
        """``members``: the languages of each n-gram, as the bits of a number of any size."""
        width = max(1, -(-len(langs) // 64))
        table = np.zeros((size, width), np.uint64)
        packed = np.array(list(members), np.uint64)
        masks = np.array([[m >> 64 * k & 0xFFFFFFFFFFFFFFFF for k in range(width)] for m in members.values()], np.uint64).reshape(-1, width)
        for at in slots(packed, size):
            np.bitwise_or.at(table, at, masks)
        fill = np.array([np.count_nonzero(bit(table, i)) / size for i in range(len(langs))])
        return cls(langs, table, fill**HASHES)

    def masks(self, packed: np.ndarray) -> np.ndarray:
        return functools.reduce(np.bitwise_and, (self.table[at] for at in slots(packed, len(self.table))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, corrected share of its n-grams, number of n-grams) of each text."""
        n = np.zeros(len(texts))
        hits = np.zeros((len(texts), len(self.langs)))
        for numbers, parts in pieces(texts):
            packed, part = grams(parts)
            own = np.array(numbers)[part]
            n += np.bincount(own, minlength=len(texts))
            found = self.masks(packed)
            for i in range(len(self.langs)):
                hits[:, i] += np.bincount(own, bit(found, i).astype(float), len(texts))
        return self.decide(hits, n)

    def word_hits(self, words: list[str]) -> np.ndarray:
        """A row for each word: how many of its n-grams each language contains, then how many it has."""
        out = np.zeros((len(words), len(self.langs) + 1))
        for numbers, parts in word_pieces(words):
            packed, part = grams(parts)
            own = np.array(numbers)[part]
            found = self.masks(packed)
            for i in range(len(self.langs)):
                out[:, i] += np.bincount(own, bit(found, i).astype(float), len(words))
            out[:, -1] += np.bincount(own, minlength=len(words))
        return out

    def decide(self, hits: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``predict`` from each text's n-grams in each language and in all."""
        if not self.langs:
            return [UNKNOWN] * len(n), np.zeros(len(n)), n
        corrected = (hits - n[:, None] * self.false) / (1 - self.false)
        best = corrected.argmax(1)
        share = np.clip(corrected[np.arange(len(n)), best] / np.maximum(n, 1), 0, 1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], share, n


def train(docs: DataFrame, sample_rows: int | None = SAMPLE_ROWS) -> Filters:
    """Filters from text and lang of ``docs``; rows without either are passed over.

    About ``sample_rows`` rows of each language are read, those of the lowest hash of doc_id and
    text, so that rows that repeat both go together; None reads all rows, whose n-grams are then counted
    once per distinct word. Languages are ordered by their rows, ties by
    name; where no n-gram is learned, from an empty table for one, the result knows no language. There
    may be any number of languages; the filter takes SLOTS words for each 64 of them, 2 MB.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    if not langs:
        return Filters.build([], {})
    known = docs.sparkSession.createDataFrame([(k, i, min(1.0, sample_rows / counts[k]) if sample_rows else 1.0) for i, k in enumerate(langs)], "lang string, number int, share double")
    numbered = labelled.select("doc_id", "text", "lang").join(F.broadcast(known), "lang")  # a row per language
    sample = numbered.filter(hash_share("doc_id", "text", F.lit("learn")) < F.col("share")).select(F.col("number").alias("lang"), "text")

    def count(batches):
        for b in batches:
            texts, of = b.column(1).to_pylist(), np.array(b.column(0).to_pylist(), np.int64)
            for numbers, parts in pieces(texts):
                packed, part = grams(parts)
                own = of[np.array(numbers)[part]]
                for lang in np.unique(own):
                    gram, n = np.unique(packed[own == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), lang, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    def count_words(batches):
        for b in batches:
            for lang, texts in by_language(b):
                found = Counter(w for t in texts for w in WORD.findall(t.lower()))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    def by_language(b):
        held: dict[int, list[str]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
        return held.items()

    def count_of_words(batches):
        for b in batches:
            of, times = np.array(b.column(0).to_pylist(), np.int64), np.array(b.column(2).to_pylist(), np.int64)
            for numbers, parts in pieces(b.column(1).to_pylist()):
                packed, part = grams(parts)
                own = np.array(numbers)[part]
                for lang in np.unique(of[own]):
                    here = of[own] == lang
                    gram, back = np.unique(packed[here], return_inverse=True)
                    n = np.zeros(len(gram), np.int64)
                    np.add.at(n, back, times[own[here]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), lang, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    if sample_rows is None:
        words = labelled.select("text", "lang").join(F.broadcast(known), "lang").select(F.col("number").alias("lang"), "text").mapInArrow(count_words, "lang int, word string, n long")
        found_grams = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).mapInArrow(count_of_words, "lang int, gram long, n long")
    else:
        found_grams = sample.mapInArrow(count, "lang int, gram long, n long")
    each = found_grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    each = materialise(each, "langid")
    totals = {r["lang"]: r["n"] for r in each.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Filters.build([], {})
    least = docs.sparkSession.createDataFrame([(k, MIN_SHARE * v) for k, v in totals.items()], "lang int, least double")
    found: dict[int, dict[int, float]] = {}  # no more than 1 / MIN_SHARE n-grams of a language
    for r in each.join(F.broadcast(least), "lang").filter(F.col("n") >= F.col("least")).collect():
        found.setdefault(r["gram"], {})[r["lang"]] = r["n"] / totals[r["lang"]]
    members = {g: sum(1 << i for i, x in by.items() if x >= MIN_RATIO * max(by.values())) for g, by in found.items()}
    return Filters.build(langs, members)


def identify(docs: DataFrame, filters: Filters, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with lang_pred, score and n_grams; columns of ``docs`` with these names give way.

    Rows that repeat are each told on their own, a text of any length is read in pieces, and an empty
    table gives an empty result.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Otherwise
    the language with most corrected n-grams, the one with more training rows on ties; score is
    the corrected share of the text's n-grams that it contains.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        lang, share, n = filters.predict(texts.to_pylist())
        return [pa.array(lang, pa.string()), pa.array(share), pa.array(n.astype(np.int64))]

    return map_text(docs, run, FIELDS, text, keep)
