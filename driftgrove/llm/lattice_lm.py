"""LM scoring by subword lattice likelihood.

The pieces of an existing vocabulary, weighted by the vocabulary's own scores, span a lattice over
each word; a word's probability is the sum over all its segmentations, by forward recursion in logs.
Piece boundaries include word boundaries, so a text's log probability is the sum over its words and
one end. Beside it stands the probability under weights fitted to the corpus, by rounds of
expectation-maximisation over all training words.

The model of the corpus is the lattice with one more way through each training word: the word as a
piece of its own, by its count less a discount. What the discount takes from all words together is
the lattice's share, so a word never seen is as likely as the lattice makes it, times that share.

Every distinct word is scored once, in a distributed table. The commonest words (a fixed number)
go to all executors; the others meet the documents in a join on the word.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrove.llm.common import crc_remainder, map_text, materialise, utf8

#: Rounds of expectation-maximisation over all distinct training words.
ROUNDS = 2
#: Words that go to all executors.
HEAD = 50_000
#: Weight, in pieces, of the vocabulary's own scores against the corpus.
PRIOR = 1000.0
#: Distinct words that a task counts before it passes them on.
FLUSH = 200_000
#: Longest word that is tried in plain probabilities, and the least probability that they may have.
SHORT, TINY = 22, 1e-250
FLOOR = 1e-12


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ``prefixes``: the number of each piece, -1 for what only begins one; ``prior``: probabilities from the scores."""

    prefixes: dict[str, int]
    byte_pieces: list[int]
    end: int
    prior: np.ndarray


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Reads a sentencepiece model. A score of -r, a rank, becomes a probability in proportion to 1 / (r + 2)."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    prefixes: dict[str, int] = {}
    n = sp.get_piece_size()
    weight = np.zeros(n)
    byte_pieces = [0] * 256
    for i in range(n):
        if sp.is_byte(i):
            byte_pieces[int(sp.id_to_piece(i)[1:-1], 16)] = i
            weight[i] = 1 / (n + 2)
        elif not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_unused(i):
            piece = sp.id_to_piece(i)
            for k in range(1, len(piece)):
                prefixes.setdefault(piece[:k], -1)
            prefixes[piece] = i
            weight[i] = 1 / (max(0.0, min(-sp.get_score(i), n)) + 2)
    end = sp.eos_id()
    weight[end] = 1 / (n + 2)
    return Vocabulary(prefixes, byte_pieces, end, weight / weight.sum())




def edges(word: str, v: Vocabulary) -> list[list[tuple[int, tuple[int, ...]]]]:
    """From each place of the word with its boundary in front: (next place, pieces). A letter without a piece goes by its bytes."""
    word = "▁" + word
    n, get = len(word), v.prefixes.get
    out = []
    for i in range(n):
        here = []
        for j in range(i + 1, n + 1):
            p = get(word[i:j])
            if p is None:
                break
            if p >= 0:
                here.append((j, (p,)))
        if not here or here[0][0] != i + 1:
            here.append((i + 1, tuple(v.byte_pieces[b] for b in word[i].encode("utf-8", "surrogatepass"))))
        out.append(here)
    return out


def log_forward(lattice: list[list[tuple[int, tuple[int, ...]]]], logp: list[float]) -> list[float]:
    """Log of the summed probability of all ways to each place."""
    incoming: list[list[float]] = [[] for _ in range(len(lattice) + 1)]
    incoming[0].append(0.0)
    alpha = []
    for i, here in enumerate([*lattice, []]):
        top = max(incoming[i])
        a = top + math.log(sum(math.exp(x - top) for x in incoming[i])) if len(incoming[i]) > 1 else top
        alpha.append(a)
        incoming[i] = []
        for j, ps in here:
            incoming[j].append(a + (logp[ps[0]] if len(ps) == 1 else sum(logp[p] for p in ps)))
    return alpha


def log_likelihoods(word: str, v: Vocabulary, weights: Sequence[Sequence[float]]) -> list[float]:
    """Natural log of the word's probability over all segmentations under each of the piece weights, by forward recursion in logs."""
    word = "▁" + word
    n, get, exp = len(word), v.prefixes.get, math.exp
    into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # (place before, piece) of the ways to each place
    by_bytes: dict[int, list[int]] = {}  # place: pieces of the letter that ends there, where it has no piece of its own
    for i in range(n):
        single = False
        for j in range(i + 1, n + 1):
            p = get(word[i:j])
            if p is None:
                break
            if p >= 0:
                into[j].append((i, p))
                single = single or j == i + 1
        if not single:
            by_bytes[i + 1] = [v.byte_pieces[b] for b in word[i].encode("utf-8", "surrogatepass")]
    out = []
    for logp in weights:
        alpha = [0.0]
        for j in range(1, n + 1):
            ways = [alpha[i] + logp[p] for i, p in into[j]]
            if j in by_bytes:
                ways.append(alpha[j - 1] + sum([logp[b] for b in by_bytes[j]]))
            top = max(ways)
            alpha.append(top + math.log(sum([exp(x - top) for x in ways])) if len(ways) > 1 else top)
        out.append(alpha[n])
    return out


def log_likelihood(word: str, v: Vocabulary, logp: Sequence[float]) -> float:
    return log_likelihoods(word, v, [logp])[0]


def _expect_short(word: str, times: float, v: Vocabulary, prob: list[float], into: list[float]) -> bool:
    """``expect`` in plain probabilities, for words short enough for them; False where they vanish nevertheless."""
    word = "▁" + word
    n, get = len(word), v.prefixes.get
    alpha = [1.0] + [0.0] * n
    steps: list[tuple] = []
    for i in range(n):
        a, single = alpha[i], False
        for j in range(i + 1, n + 1):
            p = get(word[i:j])
            if p is None:
                break
            if p >= 0:
                q = prob[p]
                steps.append((i, j, p, q))
                alpha[j] += a * q
                single = single or j == i + 1
        if not single:
            ps = tuple(v.byte_pieces[b] for b in word[i].encode("utf-8", "surrogatepass"))
            q = math.prod(prob[p] for p in ps)
            steps.append((i, i + 1, ps, q))
            alpha[i + 1] += a * q
    if alpha[n] < TINY:
        return False
    beta = [0.0] * n + [times / alpha[n]]
    for i, j, p, q in reversed(steps):
        b = q * beta[j]
        beta[i] += b
        b *= alpha[i]
        if type(p) is int:
            into[p] += b
        else:
            for x in p:
                into[x] += b
    return True


def expect(word: str, times: float, v: Vocabulary, prob: list[float], logp: list[float], into: list[float]) -> None:
    """Adds ``times`` the expected number of each piece in the word."""
    n = len(word) + 1
    if n <= SHORT and _expect_short(word, times, v, prob, into):
        return
    lattice = edges(word, v)
    alpha = log_forward(lattice, logp)
    back = [-math.inf] * n + [0.0]
    for i in range(n - 1, -1, -1):
        ways = [sum(logp[p] for p in ps) + back[j] for j, ps in lattice[i]]
        top = max(ways)
        back[i] = top + math.log(sum(math.exp(x - top) for x in ways))
        for (_, ps), x in zip(lattice[i], ways, strict=True):
            q = times * math.exp(alpha[i] + x - alpha[n])
            for p in ps:
                into[p] += q


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case."""
    return text.lower().split()


def word_counts(docs: DataFrame, text: str = "text", train: str = "train") -> DataFrame:
    """word (bytes), c: how often each word of ``docs`` occurs in the rows where ``train`` is true."""
    src = docs.select(F.col(text).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))

    def flush(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Counter[bytes] = Counter()
        other: set[bytes] = set()
        for b in batches:
            for t, own in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                if own:
                    learned.update(tokens(t))
                else:
                    other.update(tokens(t))
                if len(learned) + len(other) > FLUSH:
                    yield flush(dict.fromkeys(other, 0) | learned)
                    learned, other = Counter(), set()
        yield flush(dict.fromkeys(other, 0) | learned)

    return src.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Model:
    """``words``: word, c, lp and fit (natural logs under the vocabulary's scores and under the fitted weights) of all distinct words.

    n, v, ends: tokens, distinct tokens and ends of the training rows. prior, logp: the weights of the pieces.
    discount: what each distinct token gives to the lattice, of its count.
    """

    words: DataFrame
    n: int
    v: int
    ends: int
    prior: list[float]
    logp: list[float]
    path: str
    discount: float = 0.5

    @property
    def base_denominator(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    @property
    def lattice_share(self) -> float:
        """The lattice's part of the model; all of it where nothing was learned."""
        return self.discount * self.v / self.n if self.n else 1.0

    def model_log10(self, c: int, fit: float) -> float:
        """log10 probability of a token of count ``c`` whose natural log under the lattice is ``fit``."""
        if not c:
            return math.log10(self.lattice_share) + fit / math.log(10)
        return math.log10((c - self.discount) / self.n + self.lattice_share * math.exp(fit))


def fit_pieces(words: DataFrame, ends: int, path: str, rounds: int = ROUNDS, once: bool = False) -> list[float]:
    """Log probabilities of the pieces after ``rounds`` rounds over all rows of ``words`` with c > 0, which count c times or, with ``once``, once."""
    v = vocabulary(path)
    prob = np.maximum(v.prior, FLOOR)
    for _ in range(rounds):
        now, log_now = prob.tolist(), np.log(prob).tolist()

        def run(batches, now=now, log_now=log_now):
            own, into = vocabulary(path), [0.0] * len(now)
            for b in batches:
                for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    expect(w.decode("utf-8", "replace"), c, own, now, log_now, into)
            e = np.array(into)
            at = np.flatnonzero(e)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(e[at])], names=["piece", "e"])

        times = F.lit(1).cast("long") if once else F.col("c")
        seen = words.filter("c > 0").select("word", times.alias("c")).mapInArrow(run, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect()  # a row per piece
        got = np.zeros(len(prob))
        for r in seen:
            got[r["piece"]] = r["e"]
        got[v.end] += min(ends, 1) if once else ends
        prob = np.maximum((got + PRIOR * v.prior) / (got.sum() + PRIOR), FLOOR)
    return np.log(prob).tolist()


def discount_of(once: int, twice: int) -> float:
    """By how many tokens occur once and twice; between 0.05 and 0.95."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def train(docs: DataFrame, path: str, text: str = "text", train: str = "train", rounds: int = ROUNDS, once: bool = False) -> Model:
    """Counts all words of ``docs``, fits the pieces to those of the training rows and scores every distinct word.

    Null texts have no words but an end. Rows that repeat count again. With no training rows the
    fitted weights are the vocabulary's own. ``once``: the pieces are fitted to the distinct words, as
    the model leaves to the lattice a part of each word that doesn't grow with its count.
    """
    words = materialise(word_counts(docs, text, train), "lm-words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    ends = docs.filter(F.col(train)).count()
    prior = np.log(np.maximum(vocabulary(path).prior, FLOOR)).tolist()
    logp = fit_pieces(words, ends, path, rounds, once)
    table = materialise(scored(words, path, prior, logp), "lm-scored")
    return Model(table, total["n"] + ends, total["v"] + (ends > 0), ends, prior, logp, path, discount_of(total["once"], total["twice"]))


def scored(words: DataFrame, path: str, prior: list[float], logp: list[float]) -> DataFrame:
    """``words`` (word, c) with lp and fit."""

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            both = [log_likelihoods(w.decode("utf-8", "replace"), v, (prior, logp)) for w in b.column(0).to_pylist()]
            lp, fit = (pa.array([x[i] for x in both], pa.float64()) for i in range(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lp, fit], names=["word", "c", "lp", "fit"])

    return words.select("word", "c").mapInArrow(run, "word binary, c long, lp double, fit double")


def commonest(words: DataFrame, most: int) -> DataFrame:
    """``most`` of the words at most: all that occur at least so often, the bound found from a histogram of some thousand rows."""
    level = F.floor(F.log2(F.col("c") + 1) * 32).cast("int")
    counts = words.filter("c > 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()
    held, least = 0, None
    for r in sorted(counts, key=lambda r: -r["level"]):
        held += r["n"]
        if held > most:
            break
        least = r["least"]
    return words.filter(F.lit(False) if least is None else F.col("c") >= least)


PART = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_known", T.LongType()),
    T.StructField("base_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("fitted_score", T.DoubleType()),
    T.StructField("model_score", T.DoubleType()),
    T.StructField("__rest", T.ArrayType(T.BinaryType())),
    T.StructField("__times", T.ArrayType(T.LongType())),
]


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, head: int = HEAD, complete: bool = False) -> DataFrame:
    """``keep`` (default: all columns but text) with n_tokens, n_known, base_score, score, fitted_score and model_score.

    ``score`` is the log10 probability of the text under the vocabulary's scores, ``fitted_score``
    under the fitted weights, ``model_score`` under the model of the corpus, ``base_score`` that of the
    smoothed word counts. A null or empty text
    is one end. Rows are told apart by place, so repeated rows and null ids keep their own results;
    an empty table gives an empty result. Kept columns with the names of new ones give way to them.

    Words that the model hasn't met are scored like those it met zero times; ``complete`` says that
    there are none, which saves looking for them.
    """
    denominator, nat = model.base_denominator, math.log(10)

    def base(c: int) -> float:
        return math.log10((c + 0.5) / denominator)

    top = commonest(model.words, head).collect()  # ``head`` rows at most
    known = {bytes(r["word"]): (base(r["c"]), r["lp"] / nat, r["fit"] / nat, model.model_log10(r["c"], r["fit"]), int(r["c"] > 0)) for r in top}
    at = vocabulary(model.path).end
    end = (base(model.ends), model.prior[at] / nat, model.logp[at] / nat, model.model_log10(model.ends, model.logp[at]), int(model.ends > 0))

    def run(texts: pa.Array) -> list[pa.Array]:
        out: list[list] = [[], [], [], [], [], []]
        rest, times, ends = [], [], [0]
        for t in utf8(texts):
            words = tokens(t)
            b, s, f, m, k = end
            for w, c in Counter(words).items():
                got = known.get(w)
                if got is None:
                    rest.append(w)
                    times.append(c)
                else:
                    b += c * got[0]
                    s += c * got[1]
                    f += c * got[2]
                    m += c * got[3]
                    k += c * got[4]
            for column, x in zip(out, (len(words) + 1, k, b, s, f, m), strict=True):
                column.append(x)
            ends.append(len(rest))
        at = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(rest, pa.binary())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
        return [pa.array(x, f) for x, f in zip(out, kinds, strict=True)] + lists

    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rows = materialise(map_text(docs, run, PART, text, keep).withColumn("__row", F.monotonically_increasing_id()), "lm-rows")
    each = rows.select("__row", F.explode(F.arrays_zip("__rest", "__times")).alias("w")).select("__row", F.col("w.__rest").alias("word"), F.col("w.__times").alias("times"))
    words = model.words
    if not complete:
        unmet = each.select("word").distinct().join(words.select("word"), "word", "left_anti").withColumn("c", F.lit(0).cast("long"))
        words = words.unionByName(materialise(scored(unmet, model.path, model.prior, model.logp), "lm-unmet"))
    c, share = F.col("c"), model.lattice_share
    seen = F.log10((c - F.lit(model.discount)) / F.lit(float(max(model.n, 1))) + F.lit(share) * F.exp("fit"))
    own = F.when(c > 0, seen).otherwise(F.lit(math.log10(share)) + F.col("fit") / F.lit(nat))
    sums = each.join(words, "word").groupBy("__row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("__k"),
        F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(float(denominator)))).alias("__b"),
        F.sum(F.col("times") * F.col("lp") / F.lit(nat)).alias("__s"),
        F.sum(F.col("times") * F.col("fit") / F.lit(nat)).alias("__f"),
        F.sum(F.col("times") * own).alias("__m"),
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    mine = [f"`{c}`" for c in rows.columns if c not in {f.name for f in PART} and c != "__row"]
    added = [plus(a, b) for a, b in (("n_known", "__k"), ("base_score", "__b"), ("score", "__s"), ("fitted_score", "__f"), ("model_score", "__m"))]
    return rows.drop("__rest", "__times").join(sums, "__row", "left").select(*mine, "n_tokens", *added)


def score_held_out(docs: DataFrame, path: str, modulus: int = 5, remainder: int = 1) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) leaves another remainder, and scores all rows; an empty table gives an empty result.

    ``score`` is that of the model of the corpus, ``lattice_score`` that of the lattice alone, by the vocabulary's scores.
    """
    split = docs.select("doc_id", "text", (crc_remainder(F.col("doc_id"), modulus) == remainder).alias("held_out"))
    model = train(split.withColumn("train", ~F.col("held_out")), path, once=True)
    rows = score(split, model, complete=True)
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", F.col("model_score").alias("score"),
        F.col("score").alias("lattice_score"), "fitted_score",
    )


__all__ = ["Model", "edges", "expect", "log_likelihood", "score", "score_held_out", "tokens", "train", "vocabulary", "word_counts"]
