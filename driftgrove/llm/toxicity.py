"""Toxicity: a convolutional text classifier, trained in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its beginnings. Filters
of several widths run over the words of the whole text, and each keeps its largest value. As a
filter is linear, a word's part in every filter is computed once per distinct word and looked up.
The raw score is calibrated for each language, as told from the text, so that the best threshold
of that language becomes 0.7.

All labelled rows are used, four of five for weights, in EPOCHS passes, and every fifth for thresholds. Rows are dealt to
shards of about SHARD_ROWS; in each pass every shard goes on from the same weights in a task of its own,
and what the shards changed is averaged. A text moves once, to its shard, and only if a bitmap of hashed ids
says that it may be labelled. The driver holds weights and counts, no texts.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrove.llm import langid
from driftgrove.llm.common import hash_share, id_text, map_text

#: Labelled rows of a shard, about.
SHARD_ROWS = 4000
#: Every CALIBRATE-th row, by its hashed id, sets thresholds and is not trained on.
CALIBRATE = 5
#: Rows are counted for thresholds in steps of a logit.
STEPS = 4096
#: Changes are added as integers, so that their order doesn't matter.
FIXED = 1 << 20
#: Bits for each labelled document in the bitmap of their hashed ids.
BITS = 16
BUCKETS, DIM = 1 << 15, 12
BEGINNINGS = (3, 4, 5, 6, 7, 8, 9)
WIDTHS, FILTERS = (1, 2, 3), 12
#: Passes, however many shards there are; rows of a step.
EPOCHS, BATCH, RATE = 6, 16, 0.1
#: A language needs so many toxic rows for a threshold of its own.
LEAST_TOXIC = 12
THRESHOLD = 0.7
#: Distinct words that a worker keeps, positions of a text that it handles at once, and words of short texts.
CACHE, PIECE, GROUP = 100_000, 50_000, 8_000
WORD = re.compile(r"[^\W\d_]+")
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def word_features(word: str) -> list[int]:
    """Buckets of the word and of its beginnings, from 1; padded with 0."""
    b = word.encode("utf-8", "surrogatepass")
    out = [crc32(b) % BUCKETS + 1]
    out += [crc32(f"{word[:n]}*".encode("utf-8", "surrogatepass")) % BUCKETS + 1 for n in BEGINNINGS if n <= len(word)]
    return out + [0] * (1 + len(BEGINNINGS) - len(out))


@functools.cache
def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


def features(words: list[str]) -> np.ndarray:
    """``word_features`` of each word, letters alone, all words' beginnings a byte at a time."""
    table, first, last = crc_table(), BEGINNINGS[0], BEGINNINGS[-1]
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    width = 4 * last
    codes = np.array(raw, f"S{width + 1}").view(np.uint8).reshape(len(raw), width + 1)
    out = np.zeros((len(raw), 1 + len(BEGINNINGS)), np.uint16)
    out[:, 0] = [crc32(x) % BUCKETS + 1 for x in raw]
    state, chars = np.full(len(raw), 0xFFFFFFFF, np.uint32), np.zeros(len(raw), np.int64)
    step = lambda state, byte: table[(state ^ byte) & 255] ^ state >> 8
    for j in range(width):
        live = codes[:, j] != 0
        if not live.any():
            break
        chars += live & (codes[:, j] & 0xC0 != 0x80)
        state = step(state, codes[:, j])
        # where a character ends here and its number is that of a beginning
        at = np.flatnonzero(live & (codes[:, j + 1] & 0xC0 != 0x80) & (chars >= first) & (chars <= last))
        out[at, chars[at] - first + 1] = ~step(state[at], np.uint8(ord("*"))) % BUCKETS + 1
    return out


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class WordRows:
    """The rows that ``make`` makes of words, kept for CACHE distinct ones; row 0 is of no word and all 0."""

    def __init__(self, make: Callable[[list[str]], np.ndarray]):
        self.make, self.known, self.rows = make, {}, None

    def ids(self, words: list[str]) -> np.ndarray:
        """The row of each word; what was returned before may no longer hold."""
        new = set(words).difference(self.known)
        if self.rows is not None and len(self.known) + len(new) >= len(self.rows):
            self.known, self.rows, new = {}, None, set(words)
        if new:
            made = self.make(list(new))
            if self.rows is None:
                self.rows = np.zeros((max(CACHE, len(new)) + 1, made.shape[1]), made.dtype)
            first = len(self.known) + 1
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            self.rows[first : first + len(new)] = made
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def texts(self, texts: list[list[str]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the rows, of ``width`` columns; those of the words of padded texts; where each text begins; its length there)."""
        found = padded(self.ids([w for words in texts for w in words]), np.array([len(words) for words in texts]))
        return (np.zeros((1, width), np.float32) if self.rows is None else self.rows, *found)


def padded(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(``ids`` of texts of ``n`` words each, short texts filled up with 0; where each text begins; its length there)."""
    room = np.maximum(n, max(WIDTHS))
    starts = np.cumsum(room) - room
    out = np.zeros(room.sum(), np.int64)
    out[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return out, starts, room


def groups(texts: list[list[str]]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about GROUP words together."""
    begin, size = 0, 0
    for i, words in enumerate(texts):
        if i > begin and size + len(words) > GROUP:
            yield begin, i
            begin, size = i, 0
        size += len(words)
    if texts:
        yield begin, len(texts)


@dataclass
class Prepared:
    """Rows to fit: ``table`` has the features of their distinct words, ``words`` all texts' rows of it, of which text i has those before ``ends[i]``."""

    table: np.ndarray
    words: np.ndarray
    ends: np.ndarray
    labels: list[int]

    @classmethod
    def of(cls, texts: list[str | None], labels: list[int]) -> Prepared:
        known: dict[str, int] = {}
        words, ends = array("i"), []
        for t in texts:
            words.extend([known.setdefault(w, len(known) + 1) for w in words_of(t)])
            ends.append(len(words))
        table = np.concatenate((np.zeros((1, 1 + len(BEGINNINGS)), np.uint16), features(list(known))))
        return cls(table, np.array(words, np.int32), np.array(ends, np.int64), labels)

    def docs(self) -> list[np.ndarray]:
        return np.split(self.words, self.ends[:-1])


@dataclass
class Cnn:
    embed: np.ndarray
    filters: list[np.ndarray]  # by width: width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    kept: WordRows | None = field(default=None, repr=False)

    @classmethod
    def fresh(cls, seed: int = 7) -> Cnn:
        r = np.random.default_rng(seed)
        embed = r.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        embed[0] = 0
        filters = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(embed, filters, np.zeros(n, np.float32), r.normal(0, 0.3, n).astype(np.float32), 0.0)

    def __getstate__(self):
        return self.__dict__ | {"kept": None}

    def pooled(self, parts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest value, its place) of each filter over a text; ``parts``: of each word in each place of each filter."""
        ids = np.concatenate((ids, np.zeros(max(0, max(WIDTHS) - len(ids)), ids.dtype)))
        best, place, at = [], [], 0
        for w in WIDTHS:
            n = len(ids) - w + 1
            top, where = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
            for begin in range(0, n, PIECE):
                end = min(begin + PIECE, n)
                value = parts[at, ids[begin:end]]
                for k in range(1, w):
                    value = value + parts[at + k, ids[begin + k : end + k]]
                i = value.argmax(0)
                v = value[i, np.arange(FILTERS)]
                where, top = np.where(v > top, i + begin, where), np.maximum(v, top)
            best.append(top)
            place.append(where)
            at += w
        return np.concatenate(best), np.concatenate(place)

    def vectors(self, features: np.ndarray) -> np.ndarray:
        """Words' embeddings: the sums of those of their features, a feature of each word at a time."""
        out = self.embed.take(features[:, 0], 0)
        for k in range(1, features.shape[1]):
            out += self.embed.take(features[:, k], 0)
        return out

    def kernel(self) -> np.ndarray:
        """All places of all filters side by side."""
        return np.concatenate([w[k] for w in self.filters for k in range(len(w))], 1)

    def word_parts(self, features: np.ndarray) -> np.ndarray:
        """A row for each word: its part in each place of each filter."""
        return self.vectors(features) @ self.kernel()

    @staticmethod
    def values(found: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(width, value of its filters at each place), ``found`` being the parts of the words of padded texts."""
        at = 0
        for w in WIDTHS:
            last = len(found) - w + 1
            value = found[:last, at : at + FILTERS]
            for k in range(1, w):
                value = value + found[k : last + k, at + k * FILTERS : at + (k + 1) * FILTERS]
            yield w, value
            at += w * FILTERS

    @staticmethod
    def largest(value: np.ndarray, w: int, starts: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The largest value of each filter in each text."""
        # a text's own places, then those that reach into the next text
        cut = np.stack((starts, starts + room - w + 1), 1).ravel()[:-1] if w > 1 else starts
        return np.maximum.reduceat(value, cut, axis=0)[:: 2 if w > 1 else 1]

    def places_together(self, found: np.ndarray, starts: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``pooled`` for several padded texts, a row for each; places are those in all of them, the first of several."""
        best, place, text = [], [], np.repeat(np.arange(len(room)), room)
        inside = np.repeat(starts + room, room) - np.arange(len(found))
        for w, value in self.values(found):
            top = self.largest(value, w, starts, room)
            at, of = np.nonzero((value == top[text[: len(value)]]) & (inside[: len(value), None] >= w))
            first = np.repeat(starts[:, None], FILTERS, 1)
            first[text[at[::-1]], of[::-1]] = at[::-1]
            best.append(top)
            place.append(first)
        return np.concatenate(best, 1), np.concatenate(place, 1)

    def logit(self, pooled: np.ndarray) -> float:
        return float(np.maximum(pooled + self.bias, 0) @ self.out) + self.out_bias

    def gradients(self, table: np.ndarray, docs: list[np.ndarray], labels: list[int], up: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, float, np.ndarray, np.ndarray]:
        """Sums over some texts of the log loss's gradients: of filters, bias, out and out_bias; then feature rows and the gradient of the embeddings in each.

        ``docs``: the words of each text as rows of ``table``, which has their features and no feature in row 0.
        """
        n = np.array([len(doc) for doc in docs])
        own, ids = np.unique(np.concatenate(docs), return_inverse=True)
        own, ids = np.concatenate(([0], own)), ids + 1
        feats = table[own]
        x = self.vectors(feats)
        ids, starts, room = padded(ids, n)
        if len(ids) > PIECE:
            parts = np.stack([x @ w[k] for w in self.filters for k in range(len(w))])
            pooled, place = (np.stack(a) for a in zip(*(self.pooled(parts, ids[s : s + r]) for s, r in zip(starts, room, strict=True)), strict=True))
            place += starts[:, None]
        else:
            pooled, place = self.places_together((x @ self.kernel()).take(ids, 0), starts, room)
        h = np.maximum(pooled + self.bias, 0)
        z = (h * self.out).sum(1).astype(np.float64) + self.out_bias
        label = np.array(labels)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * np.where(label, up, 1.0)
        g_h = np.where(h > 0, g[:, None] * self.out, 0).astype(self.out.dtype)
        grads, rows, steps = [np.zeros_like(w) for w in self.filters], [], []
        for i, w in enumerate(WIDTHS):
            cut = slice(i * FILTERS, (i + 1) * FILTERS)
            own_g = g_h[:, cut]
            live = own_g != 0
            for k in range(w):
                at = ids[place[:, cut] + k]
                grads[i][k] = (x[at] * own_g[:, :, None]).sum(0).T
                rows.append(feats[at[live]])
                steps.append((own_g[:, :, None] * self.filters[i][k].T)[live])
        return grads, g_h.sum(0), (g[:, None] * h).sum(0).astype(self.out.dtype), float(g.sum()), np.concatenate(rows), np.concatenate(steps)

    def start(self) -> list[np.ndarray]:
        """Adagrad's sums of squares: of embeddings, filters, bias, out, out_bias."""
        return [np.full_like(x, 1e-2) for x in self.weights()]

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, np.array([self.out_bias])]

    def fit_pass(self, rows: Prepared, sums: list[np.ndarray], up: float, rate: float, seed: int) -> list[np.ndarray]:
        """A pass of Adagrad on log loss; returns the new sums."""
        docs, labels, table = rows.docs(), rows.labels, rows.table
        bias_sum = float(sums[-1][0])
        line = np.random.default_rng((7, seed)).permutation(len(docs))
        for begin in range(0, len(line), BATCH):
            some = line[begin : begin + BATCH]
            grads, g_bias, g_out, g_c, rows, steps = self.gradients(table, [docs[d] for d in some], [labels[d] for d in some], up)
            for x, gx, s in zip((*self.filters, self.bias, self.out), (*grads, g_bias, g_out), sums[1:-1], strict=True):
                gx = gx / BATCH
                s += gx * gx
                x -= rate * gx / np.sqrt(s)
            g_c /= BATCH
            bias_sum += g_c * g_c
            self.out_bias -= rate * g_c / math.sqrt(bias_sum)
            if len(rows):
                touched, back = np.unique(rows, return_inverse=True)
                steps = np.repeat(steps / BATCH, rows.shape[1], axis=0)
                ge = np.stack([np.bincount(back.ravel(), step, len(touched)) for step in steps.T], 1).astype(np.float32)
                ge[touched == 0] = 0
                sums[0][touched] += ge * ge
                self.embed[touched] -= rate * ge / np.sqrt(sums[0][touched])
        return [*sums[:-1], np.array([bias_sum])]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        if self.kept is None:
            self.kept = WordRows(lambda words: self.word_parts(features(words)))
        words, out = [words_of(t) for t in texts], []
        for begin, end in groups(words):
            found = self.kept.texts(words[begin:end], sum(WIDTHS) * FILTERS)
            out += self.logits_of(*found, 0)
        return np.array(out)

    def logits_of(self, rows: np.ndarray, ids: np.ndarray, starts: np.ndarray, room: np.ndarray, first: int) -> list[float]:
        """The raw scores of padded texts, the parts of whose words are in ``rows`` from column ``first`` on; short texts go through together, longer ones than PIECE in pieces."""
        if len(ids) > PIECE:
            at = rows[:, first:].reshape(len(rows), -1, FILTERS).transpose(1, 0, 2)
            return [self.logit(self.pooled(at, ids[s : s + r])[0]) for s, r in zip(starts, room, strict=True)]
        best = [self.largest(value, w, starts, room) for w, value in self.values(rows[ids, first:])]
        # summed row by row, so that the same words score the same in any company
        return ((np.maximum(np.concatenate(best, 1) + self.bias, 0) * self.out).sum(1).astype(np.float64) + self.out_bias).tolist()


def upward(toxic: int, n: int) -> float:
    """The weight of the toxic rows, as the rarer ones; 4 at most."""
    share = max(toxic, 1) / max(n, 1)
    return min(4.0, (1 - share) / share) if share < 1 else 1.0


def best_threshold(values: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """Halfway between the two neighbouring values that split the rows with the best F1; the lowest of several. ``n``: rows of each value, ``toxic`` of them."""
    order = np.argsort(-values, kind="stable")
    z, hits, rows = values[order], np.cumsum(toxic[order]), np.cumsum(n[order])
    f1 = 2 * hits / (rows + hits[-1])
    i = len(f1) - 1 - int(f1[::-1].argmax())
    return float(z[i] + z[i + 1]) / 2 if i + 1 < len(z) else float(z[i]) - 1.0


@dataclass
class Classifier:
    cnn: Cnn | None
    languages: langid.Filters
    thresholds: dict[str, float]
    kept: WordRows | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"kept": None}

    def language(self, texts: list[str | None]) -> list[str]:
        """As by ``languages.predict``, from the n-grams of each distinct word."""
        return self.judge(texts)[0]

    def word_rows(self, words: list[str]) -> np.ndarray:
        hits = self.languages.word_hits(words).astype(np.float32)
        return hits if self.cnn is None else np.concatenate((hits, self.cnn.word_parts(features(words))), 1)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, raw score) of each text; a word is looked up once for both."""
        if self.kept is None:
            self.kept = WordRows(self.word_rows)
        words, k = [words_of(t) for t in texts], len(self.languages.langs) + 1
        sums, z = np.zeros((len(texts), k)), np.zeros(len(texts))
        for begin, end in groups(words):
            rows, ids, starts, room = self.kept.texts(words[begin:end], k + (0 if self.cnn is None else sum(WIDTHS) * FILTERS))
            if len(ids) > PIECE:
                sums[begin:end] = [sum(rows[ids[at : min(at + PIECE, s + r)], :k].sum(0, dtype=np.float64) for at in range(s, s + r, PIECE)) for s, r in zip(starts, room, strict=True)]
            else:
                sums[begin:end] = np.add.reduceat(rows[ids, :k], starts, axis=0, dtype=np.float64)
            if self.cnn is not None:
                z[begin:end] = self.cnn.logits_of(rows, ids, starts, room, k)
        return self.languages.decide(sums[:, :-1], sums[:, -1])[0], z

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.cnn is None:
            return np.zeros(len(texts))
        langs, z = self.judge(texts)
        at = np.array([self.thresholds.get(x, self.thresholds[""]) for x in langs])
        z = z - at + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pack(arrays: list[np.ndarray]) -> bytes:
    """Integers, signs in the lowest bit, byte by byte: those of the highest bytes are nearly all 0."""
    found = []
    for x in arrays:
        signed = (x << 1 ^ x >> 63).astype("<u4" if np.abs(x).max() < 1 << 30 else "<u8")
        found.append((x.shape, np.ascontiguousarray(signed.reshape(-1, 1).view(np.uint8).T)))
    return zlib.compress(pickle.dumps(found), 1)


def unpack(packed: bytes) -> list[np.ndarray]:
    out = []
    for shape, planes in pickle.loads(zlib.decompress(packed)):
        x = np.ascontiguousarray(planes.T).view(f"<u{len(planes)}").astype(np.int64).reshape(shape)
        out.append((x >> 1) ^ -(x & 1))
    return out


def shard_rows(rows: Iterable, held: bool) -> tuple[list[str | None], list[int]]:
    """Texts and labels of a shard's rows for thresholds or of the others; of several texts of a document the smallest."""
    found: dict = {}
    for r in rows:
        if r["held"] == held:
            text = found[r["doc_id"]][0] if r["doc_id"] in found else None
            found[r["doc_id"]] = (r["text"] if text is None else text if r["text"] is None else min(text, r["text"]), int(r["toxic"]))
    order = sorted(found, key=lambda k: (crc32(str(k).encode()), k))
    return [found[k][0] for k in order], [found[k][1] for k in order]


def fit_shards(shards: RDD, cnn: Cnn, up: float) -> Cnn:
    """EPOCHS passes over all rows: of weights that all shards change, the mean of their changes counts, of an embedding that of the shards that have it."""

    def prepare(rows):
        texts, labels = shard_rows(rows, False)
        if texts:
            yield Prepared.of(texts, labels)

    sums = cnn.start()
    ready = shards.mapPartitions(prepare).persist(StorageLevel.DISK_ONLY)
    for epoch in range(EPOCHS):
        shared = shards.context.broadcast((cnn, sums))

        def change(rows, shared=shared, epoch=epoch):
            total = None
            for own_rows in rows:
                # the broadcast value serves other shards and tasks of the worker
                own, own_sums = pickle.loads(pickle.dumps(shared.value))
                before = [x.astype(np.float64) for x in (*own.weights(), *own_sums)]
                own_sums = own.fit_pass(own_rows, own_sums, up, RATE * (1 - epoch / (EPOCHS + 1)), epoch)
                after = (*own.weights(), *own_sums)
                moved = [np.rint((x - y) * FIXED).astype(np.int64) for x, y in zip(after, before, strict=True)]
                moved = [np.array([1]), moved[0].any(1).astype(np.int64), *moved]
                total = moved if total is None else [x + y for x, y in zip(total, moved, strict=True)]
            if total is not None:
                yield pack(total)

        # a task for each core: the shards of a task are added up before they move
        slots = ready.coalesce(shards.context.defaultParallelism)
        total = unpack(slots.mapPartitions(change).treeReduce(lambda a, b: pack([x + y for x, y in zip(unpack(a), unpack(b), strict=True)]), 3))
        shared.unpersist()
        n, touched, moved = total[0][0], np.maximum(total[1], 1)[:, None], total[2:]
        k = len(sums)
        by = [touched if i % k == 0 else n for i in range(2 * k)]
        new = [(x + m / FIXED / d).astype(x.dtype) for x, m, d in zip((*cnn.weights(), *sums), moved, by, strict=True)]
        cnn = Cnn(new[0], new[1 : 1 + len(WIDTHS)], new[k - 3], new[k - 2], float(new[k - 1][0]))
        sums = new[k:]
    ready.unpersist()
    return cnn


def bitmap(ids: DataFrame, bits: int) -> DataFrame:
    """The hashes of ``doc_id``, modulo ``bits``, as rows of a bitmap: bucket, bits."""
    at = id_bit(bits)
    return ids.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))


def id_bit(bits: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1


def may_have(docs: DataFrame, ids: DataFrame, bits: int) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``, and a few in a hundred of the others; no row is exchanged."""
    at = id_bit(bits)
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.col("__bits").substr(F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = docs.withColumn("__bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bitmap(ids, bits)), "__bucket")
    return near.filter(F.getbit(byte, place % 8) == 1).select(*docs.columns)


def labelled(docs: DataFrame, marks: DataFrame, share: Column, shards: int, held: Column) -> RDD:
    """The rows of ``docs`` that have a mark, with it, dealt to shards by ``share`` of their id. Marks and texts meet in the shard, so that a text moves once."""
    number = F.floor(share * shards).cast("int").alias("shard")
    bits = max(1, marks.count()) * BITS
    texts = may_have(docs.select("doc_id", "text"), marks, bits).select("doc_id", "text", F.lit(None).cast("int").alias("toxic"), held.alias("held"), number)
    rows = texts.unionByName(marks.select("doc_id", F.lit(None).cast("string").alias("text"), F.col("toxic").cast("int"), held.alias("held"), number))

    def meet(rows):
        marked, texts = {}, []
        for doc, text, toxic, held, _ in rows:
            if toxic is None:
                texts.append((doc, text, held))
            else:
                marked[doc] = toxic
        for doc, text, held in texts:
            if doc in marked:
                yield {"doc_id": doc, "text": text, "toxic": marked[doc], "held": held}

    # every pass reads the same shuffle files again
    return rows.rdd.map(lambda r: (r["shard"], tuple(r))).partitionBy(shards, int).values().mapPartitions(meet)


def train(docs: DataFrame, labels: DataFrame, shard: int = SHARD_ROWS) -> Classifier:
    """A classifier of the texts of ``docs`` by ``labels.toxic``.

    All labelled texts are used, whole; a task must hold those of a shard, about ``shard`` rows. Null
    labels and ids are passed over; of several labels of a document the highest counts, of several
    texts the smallest; without both classes among the rows to fit, from empty tables for one, every
    score is 0.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = lambda what: hash_share(F.concat(id_text(F.col("doc_id")), F.lit(what)))
    found = docs.select("doc_id").join(marks, "doc_id").withColumn("held", part(":fit") < 1 / CALIBRATE)
    counts = found.filter("NOT held").select("doc_id", "toxic").distinct().groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n, toxic = sum(r["n"] for r in counts), sum(r["n"] for r in counts if r["toxic"])
    if len(counts) < 2:
        return Classifier(None, langid.Filters.build([], {}), {})
    shards = labelled(docs, marks, part(":shard"), max(1, round(n / shard)), part(":fit") < 1 / CALIBRATE)
    cnn = fit_shards(shards, Cnn.fresh(), upward(toxic, n))
    told = Classifier(cnn, langid.train(docs, sample_rows=None), {})

    def steps(rows):
        texts, labels = shard_rows(rows, True)
        if texts:
            langs, z = told.judge(texts)
            at = np.rint(np.clip(z, -30, 30) * STEPS).astype(int).tolist()
            for lang, z, y in zip(langs, at, labels, strict=True):
                yield (lang, z), (int(y), 1)

    found_steps = shards.mapPartitions(steps).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collect()  # steps of the languages
    by_language: dict[str, dict[int, np.ndarray]] = {"": {}}
    for (lang, z), yn in found_steps:
        for x in {"", lang}:
            held = by_language.setdefault(x, {})
            held[z] = held.get(z, 0) + np.array(yn)
    told.thresholds[""] = 0.0
    for x, held in by_language.items():
        if sum(yn[0] for yn in held.values()) >= (LEAST_TOXIC if x else 1):
            z, yn = np.array(list(held)) / STEPS, np.array(list(held.values()))
            told.thresholds[x] = best_threshold(z, yn[:, 0], yn[:, 1])
    return told


def score(docs: DataFrame, model: Classifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with score and predicted (1 from 0.7).

    Null and empty texts are scored as texts without words, long ones whole, PIECE words at a time.
    Rows that repeat get the same score, an empty table gives an empty result, and kept columns
    named score or predicted give way to the new ones.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        s = model.scores(texts.to_pylist())
        return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

    return map_text(docs, run, FIELDS, text, keep)
