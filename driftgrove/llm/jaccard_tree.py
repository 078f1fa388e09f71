"""N-gram Jaccard join with signature trees.

Two documents link when the Jaccard likeness of their sets of distinct five-word shingles is 0.8
or more. The join is exact (shingles are compared by 64-bit hashes) and runs in these steps:

1. A sketch of fixed size counts all shingles, so that common ones can be put last.
2. Equal sets become one class, told apart by a 128-bit digest; its first half is the class's id, unless
   two classes share it, which then take others. A class is known by its size, a
   bitmap of its shingles and its prefix: so many of its rarest shingles that two linked sets
   share one of them. Only prefixes are exchanged, once, and each task passes a class on once.
3. Classes that share a prefix shingle form a bucket; buckets with the same classes are one. In
   each bucket a signature tree (nodes with OR-combined bitmaps and size ranges) is traversed
   against itself; node pairs whose largest possible overlap is too small are pruned, and so are
   those that are connected already. What is left is a spanning forest of the pairs that may link.
4. Components of these forests are blocks. Only for classes in blocks are the sets themselves
   made, from one document of each class. In each block the same traversal compares sets exactly
   and connects those that link.

A bucket or block is handled in one task if it is small, by classes and by bytes. A larger one is
split by size, as only sets of neighbouring sizes link, and what is still too large is cut into
chunks. Each chunk is joined with itself and with the first one; a group of near copies is mostly
one component after that. Then only classes outside the group's largest component are left, and
each of these is compared with every other class, in larger chunks. So a task holds two chunks at
most, and the rows that are sent grow with the number of such outsiders, not with the square of
the group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from driftgrove.llm.common import map_text, materialise, small_batches, utf8

WORDS = 5
#: Counters of the sketch, and how many are passed on in one row.
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: Bits of a bitmap: the least and the most; in between EACH for a shingle at least.
LEAST_BITS, MOST_BITS, EACH = 512, 1 << 18, 2
LEAF = 32
#: Classes, and bytes of their bitmaps or sets, of a chunk; a task holds two. MAX_PAIRS: classes of a chunk that outsiders meet.
MAX_CLASSES, MAX_BYTES, MAX_PAIRS = 120, 32 << 20, 2000
#: Rows that are broadcast at most; beyond it the join shuffles.
MAX_BROADCAST = 500_000
#: Edges that a task contracts at a time.
MOST_EDGES = 500_000
#: Bytes of text that are hashed at once.
PIECE = 1 << 19
#: Classes that a task remembers, not to pass their prefixes on again.
SEEN = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of a word that are hashed eight at a time; longer words are hashed one by one.
LONG_WORD = 64
#: A to Z as a to z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: The first k bytes of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(31)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each word of the bytes begins, its hash); the bytes end with white space.

    Each step mixes eight more bytes of the words that have them; it is one-to-one in these bytes,
    so words of up to eight never collide.
    """
    low = LOWER[text]
    blank = BLANK[low]
    begin = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    size = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1]))) - begin
    padded = np.concatenate((low, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))
    out = _mixed(size.astype(np.uint64) * MIX + np.uint64(WORDS))
    for k in range(0, LONG_WORD, 8):
        at = np.flatnonzero(size > k) if k else slice(None)
        if k and not len(at):
            break
        chunk = eight[begin[at] + k] & FIRST[np.minimum(size[at] - k, 8)]
        out[at] = _mixed((out[at] ^ chunk) * MIX)
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(low[begin[i] : begin[i] + size[i]].tobytes(), int(size[i]))
    return begin, out


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed(out * MIX + h[k : len(h) - width + 1 + k])
    return out


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end]) + 1
            end += 1
        group = texts[at:end]
        edges = np.cumsum([0] + [len(t) + 1 for t in group])
        begin, h = word_hashes(np.frombuffer(b" ".join(group) + b" ", np.uint8))
        words = np.searchsorted(begin, edges)
        whole = _rolled(h, WORDS) if len(h) >= WORDS else h[:0]
        for a, b in zip(words, words[1:], strict=False):
            if b - a >= WORDS:
                yield np.unique(whole[a : b - WORDS + 1])
            else:
                yield _rolled(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)
        at = end


def prefix_size(n: int) -> int:
    """So many first shingles of a set of n, in any fixed order, that linked sets share one."""
    return n - (4 * n + 4) // 5 + 1


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits of the shingles, one each: a power of two of bits, from EACH to twice as many per shingle.

    A bitmap folds to half its width by OR of its halves.
    """
    n = min(MOST_BITS, max(LEAST_BITS, 1 << (EACH * len(s) - 1).bit_length()))
    bits = np.zeros(n, np.uint8)
    bits[((s >> np.uint64(24)) & np.uint64(n - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def links(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with ``common`` shingles in common link: 100 * intersection >= 80 * union."""
    return 9 * common >= 4 * (a + b)


class SignatureTree:
    """A binary tree over sets in order of size; a node is a range of places.

    Wider bitmaps belong to larger sets. Two nodes are compared at the width of the smallest set.
    Sets with the same label are connected from the start.
    """

    def __init__(self, sizes: np.ndarray, bits: list[np.ndarray], labels: np.ndarray | None = None):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order].astype(np.int64)
        self.widths = np.array([len(bits[i]) for i in self.order])
        #: By width: the bitmaps of all sets from the first that is so wide, and shingles beyond one for each bit.
        self.folded: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        rest: list[np.ndarray] = []
        for w in np.unique(self.widths)[::-1].tolist():
            at = np.flatnonzero(self.widths == w)
            own = np.stack([bits[self.order[i]] for i in at])
            if rest:
                above = rest[0]
                while above.shape[1] > w:
                    above = above[:, : above.shape[1] // 2] | above[:, above.shape[1] // 2 :]
                own = np.concatenate((own, above))
            rest = [own]
            first = int(at[0])
            self.folded[w] = first, own, self.sizes[first:] - np.bitwise_count(own).sum(1).astype(np.int64)
        self.label = np.arange(len(sizes)) if labels is None else np.unique(labels, return_inverse=True)[1][self.order]
        self.nodes: dict[tuple[int, int, int], tuple[np.ndarray, int]] = {}

    def node(self, a: int, b: int, w: int) -> tuple[np.ndarray, int]:
        """OR of the bitmaps, and largest excess, at a width."""
        got = self.nodes.get((a, b, w))
        if got is None:
            if b - a <= LEAF:
                first, bits, excess = self.folded[w]
                got = np.bitwise_or.reduce(bits[a - first : b - first]), int(excess[a - first : b - first].max())
            else:
                left, right = self.node(a, (a + b) // 2, w), self.node((a + b) // 2, b, w)
                got = left[0] | right[0], max(left[1], right[1])
            self.nodes[a, b, w] = got
        return got

    def may_link(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """False if the largest overlap that the nodes' bitmaps and sizes allow is too small."""
        low_a, high_a, low_b, high_b = self.sizes[a[0]], self.sizes[a[1] - 1], self.sizes[b[0]], self.sizes[b[1] - 1]
        if 5 * high_a < 4 * low_b or 5 * high_b < 4 * low_a:
            return False
        w = int(self.widths[min(a[0], b[0])])
        (or_a, ex_a), (or_b, ex_b) = self.node(*a, w), self.node(*b, w)
        overlap = min(int(np.bitwise_count(or_a & or_b).sum()) + min(ex_a, ex_b), high_a, high_b)
        return 9 * overlap >= 4 * (low_a + low_b)

    def cut(self, r: tuple[int, int]) -> int:
        """Where to split a range: at its first change of width, else in the middle if it is large, else nowhere (0)."""
        first = self.widths[r[0]]
        if first != self.widths[r[1] - 1]:
            return r[0] + int(np.searchsorted(self.widths[r[0] : r[1]], first, side="right"))
        return (r[0] + r[1]) // 2 if r[1] - r[0] > LEAF else 0

    def connected(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        x, y = self.label[a[0] : a[1]], self.label[b[0] : b[1]]
        return x[0] == y[0] and (x == x[0]).all() and (y == y[0]).all()

    def join(self, verify: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
        """Edges of a spanning forest of the pairs that link, or may link without ``verify``.

        ``verify(j, places)`` tells which of the sets at ``places`` link with the one at ``j``.
        """
        found: list[tuple[int, int]] = []
        todo = [((0, len(self.sizes)), (0, len(self.sizes)))] if len(self.sizes) > 1 else []
        while todo:
            a, b = todo.pop()
            if not self.may_link(a, b) or self.connected(a, b):
                continue
            cuts = {r: c for r in (a, b) if (c := self.cut(r))}
            if cuts:
                big = max(cuts, key=lambda r: r[1] - r[0])
                left, right = (big[0], cuts[big]), (cuts[big], big[1])
                if a == b:
                    todo += [(left, right), (right, right), (left, left)]
                else:
                    other = b if big is a else a
                    todo += [(left, other), (right, other)]
                continue
            sa, sb = self.sizes[a[0] : a[1]], self.sizes[b[0] : b[1]]
            first, bits, excess = self.folded[int(self.widths[min(a[0], b[0])])]
            at, to = slice(a[0] - first, a[1] - first), slice(b[0] - first, b[1] - first)
            both = np.bitwise_count(bits[at, None] & bits[None, to]).sum(2).astype(np.int64)
            both += np.minimum(excess[at, None], excess[None, to])
            both = np.minimum(both, np.minimum(sa[:, None], sb[None]))
            may = links(both, sa[:, None], sb[None])
            if a == b:
                may = np.triu(may, 1)
            for j in np.flatnonzero(may.any(0)):
                place = b[0] + int(j)
                near = a[0] + np.flatnonzero(may[:, j])
                near = near[self.label[near] != self.label[place]]
                if verify is not None and len(near):
                    near = near[verify(place, near)]
                for i in near:
                    old, new = self.label[place], self.label[i]
                    if old != new:
                        self.label[self.label == old] = new
                        found.append((int(self.order[i]), int(self.order[place])))
        return found


def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with the same first column, across batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy(zero_copy_only=False)
        if held and held[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def stars(edges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each end of the edges with the smallest of its component, but for the smallest itself.

    Groups that overlap mostly have the same smallest classes, so their stars mostly have the same edges.
    """
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.setdefault(top, top)) != top:
            top = above
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, r) for x in up if (r := root(x)) != x]


def contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the edges (u, v) of a task, MOST_EDGES at a time: never more edges than there are ends."""
    held: list[tuple[int, int]] = []
    for b in batches:
        held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        if len(held) > MOST_EDGES:
            held = stars(held)
            if len(held) > MOST_EDGES // 2:
                yield edge_batch(held)
                held = []
    yield edge_batch(stars(held))


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    """Each edge as (larger, smaller)."""
    return pa.RecordBatch.from_arrays([pa.array([max(e) for e in edges], pa.int64()), pa.array([min(e) for e in edges], pa.int64())], names=["u", "v"])


def may_link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, cls, label, done, size, bits) in order of task: edges between classes that may link."""
    out: list[tuple[int, int]] = []
    for g in groups(batches):
        cls = g.column(1).to_pylist()
        done = g.column(3).to_pylist()
        tree = SignatureTree(g.column(4).to_numpy(), [np.frombuffer(x, np.uint64) for x in g.column(5).to_pylist()], g.column(2).to_numpy())
        out += stars((cls[i], cls[j]) for i, j in tree.join() if not done[i] & done[j])
        if len(out) > 20_000:
            yield edge_batch(out)
            out = []
    yield edge_batch(out)


def do_link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, cls, label, done, set) in order of task: edges between classes that link."""
    out: list[tuple[int, int]] = []
    for g in groups(batches):
        cls = g.column(1).to_pylist()
        done = g.column(3).to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in g.column(4).to_pylist()]
        tree = SignatureTree(np.array([len(s) for s in sets]), [bitmap(s) for s in sets], g.column(2).to_numpy())
        sets = [sets[i] for i in tree.order]
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([0, *map(len, sets)])
        seen = np.zeros(int(number.max()) + 1, np.int32)

        def verify(j, places, tree=tree, number=number, ends=ends, seen=seen):
            own = number[ends[j] : ends[j + 1]]
            seen[own] = 1
            first, last = int(places[0]), int(places[-1]) + 1
            common = np.add.reduceat(seen[number[ends[first] : ends[last]]], ends[first:last] - ends[first])[places - first]
            seen[own] = 0
            return links(common.astype(np.int64), tree.sizes[places], tree.sizes[j])

        out += stars((cls[i], cls[j]) for i, j in tree.join(verify) if cls[i] != cls[j] and not done[i] & done[j])
        if len(out) > 20_000:
            yield edge_batch(out)
            out = []
    yield edge_batch(out)


def sketch(docs: DataFrame, text: str) -> np.ndarray:
    """How far above the mean each counter of shingles is, as a power of two; 0 for up to four times the mean."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for s in shingle_sets(utf8(b.column(0))):
                np.add.at(total, (s % np.uint64(COUNTERS)).astype(np.int64), 1)
        yield from passed(total)

    def passed(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        small = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(-1, CHUNK)
        at = np.flatnonzero(small.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([small[i].tobytes() for i in at], pa.binary())], names=["at", "n"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(n, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["at", "n"])

    small_batches(docs.sparkSession)
    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "at int, n binary")
    total = np.zeros((COUNTERS // CHUNK, CHUNK), np.int64)
    for r in counted.repartition("at").mapInArrow(add, "at int, n binary").collect():  # COUNTERS numbers
        total[r["at"]] = np.frombuffer(r["n"], np.int64)
    over = total.ravel() / max(total.mean(), 1e-9)
    return np.where(over > 4, np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


ROW = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("cls", T.LongType()),
    T.StructField("more", T.LongType()),
    T.StructField("bits", T.BinaryType()),
    T.StructField("prefix", T.ArrayType(T.LongType(), False)),
]


def digest(s: np.ndarray) -> tuple[int, int]:
    """The two halves of a set's 128-bit digest."""
    high, low = divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64)
    return low - (1 << 63), high - (1 << 63)


def described(docs: DataFrame, text: str, key: str, levels: np.ndarray) -> DataFrame:
    """key, n_shingles, cls and more (the digest), bits and prefix of every row; a class that a task has met before comes without its prefix."""
    seen: set[tuple[int, int]] = set()  # of the task: each has its own copy

    def run(texts: pa.Array) -> list[pa.Array]:
        sets = list(shingle_sets(utf8(texts)))
        classes = [digest(s) if len(s) else None for s in sets]
        prefixes = []
        for s, c in zip(sets, classes, strict=True):
            if c is None or c in seen:
                prefixes.append(s[:0])
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(c)
            order = np.argsort(levels[(s % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")
            prefixes.append(s[order[: prefix_size(len(s))]])
        ends = pa.array(np.cumsum([0, *map(len, prefixes)], dtype=np.int32))
        flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)
        return [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([c and c[0] for c in classes], pa.int64()),
            pa.array([c and c[1] for c in classes], pa.int64()),
            pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            pa.ListArray.from_arrays(ends, pa.array(flat)),
        ]

    return map_text(docs, run, ROW, text, [key])


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has no more than MAX_BROADCAST rows."""
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def size_level(size: Column) -> Column:
    """Sets link only if their levels are the same or next to each other: one is at most 1.25 times the other."""
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(1.25) * (1 + 1e-9))).cast("int")


def weighed(members: DataFrame, each: Column, classes: int) -> DataFrame:
    """group, chunks: how many chunks of so many classes a group (group, cls, size) needs; ``each``: the bytes of a class."""
    held = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("bytes"))
    return held.select("group", F.greatest(F.ceil(F.col("n") / classes), F.ceil(F.col("bytes") / MAX_BYTES)).cast("int").alias("chunks"))


def connect(members: DataFrame, rows: DataFrame, each: Column, verify: Callable, name: str) -> DataFrame:
    """u, v: edges that connect what ``verify`` links within each group of ``members`` (group, cls, size).

    ``rows``: group, cls and what ``verify`` takes after (task, cls, label, done). Of the rows of a
    task, pairs that have a bit of ``done`` in common are settled in another task.
    ``each``: bytes of a class.
    """
    payload = [c for c in rows.columns if c not in ("group", "cls")]

    def run(tasks: DataFrame) -> DataFrame:
        return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(verify, "u long, v long")

    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.col("group").alias("task"), "cls", F.col("cls").alias("label"), F.lit(0).alias("done"), *payload)

    large = materialise(weighed(members, each, MAX_CLASSES).filter("chunks > 1").select("group"), f"{name}-large")
    n = large.count()
    if not n:
        return run(plain(rows)).distinct()
    rows = materialise(rows, f"{name}-rows")
    edges = run(plain(rows.join(few(large, n), "group", "left_anti")))
    big = materialise(rows.join(few(large, n), "group", "left_semi").select("cls", *payload).dropDuplicates(["cls"]), f"{name}-big")
    send = lambda tasks: run(tasks.join(big, "cls").select("task", "cls", "label", "done", *payload))

    level = size_level(F.col("size"))
    sides = F.array(F.struct(F.xxhash64("group", level).alias("group"), F.lit(0).alias("low")), F.struct(F.xxhash64("group", level + 1).alias("group"), F.lit(1).alias("low")))
    split = members.join(few(large, n), "group").select("cls", "size", F.explode(sides).alias("g")).select("g.group", "g.low", "cls", "size")
    chunks = materialise(weighed(split, each, MAX_CLASSES), f"{name}-chunks")
    split = split.join(few(chunks, chunks.count()), "group").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    split = materialise(split, f"{name}-split")
    to = F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    cut = split.select("group", "low", "chunk", "cls", F.explode(to).alias("at"))
    first = cut.select(F.xxhash64("group", "at").alias("task"), "cls", F.col("cls").alias("label"), (F.col("low") + F.when(F.col("chunk") != F.col("at"), 2).otherwise(0)).alias("done"))
    edges = materialise(edges.unionByName(send(first)).distinct(), f"{name}-edges")

    left = split.filter("chunks > 1").join(components(edges, f"{name}-first"), "cls", "left").select("group", "cls", "size", F.coalesce("root", "cls").alias("label"))
    left = materialise(left, f"{name}-left")
    sizes = left.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    most = materialise(sizes.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("most")), f"{name}-most")
    rest = materialise(left.join(few(most, most.count()), "group").filter("label <> most").drop("most"), f"{name}-rest")
    parts = materialise(weighed(rest, each, MAX_PAIRS).withColumnRenamed("chunks", "parts").join(weighed(left, each, MAX_PAIRS), "group"), f"{name}-parts")
    m = parts.count()
    if not m:
        return edges
    at = lambda count, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    outside = rest.join(few(parts, m), "group").select("group", at("parts", 1).alias("part"), every("chunks").alias("chunk"), "cls", "label", F.lit(0).alias("done"))
    inside = left.join(few(parts, m), "group").select("group", every("parts").alias("part"), at("chunks", 2).alias("chunk"), "cls", "label", F.lit(4).alias("done"))
    pairs = outside.unionByName(inside).groupBy(F.xxhash64("group", "part", "chunk").alias("task"), "cls", "label").agg(F.min("done").alias("done"))
    return edges.unionByName(send(pairs)).distinct()


def candidate_edges(classes: DataFrame, described_rows: DataFrame) -> DataFrame:
    """u, v: a forest of the pairs of classes that may link.

    All prefix shingles are exchanged once, 16 bytes for each class that holds one; a shingle that many
    classes share meets them in one task there, as such narrow rows. After that it is a hot key only
    of joins, which adaptive execution splits, and of aggregates, which combine before their exchange.
    """
    # one exchange, of a shingle and a class each: the grouping and the window both follow from it
    each = described_rows.select("cls", F.explode("prefix").alias("token")).repartition("token").groupBy("token", "cls").agg(F.lit(1).alias("one"))
    w = Window.partitionBy("token")
    met = each.select("token", "cls", F.min("cls").over(w).alias("a"), F.max("cls").over(w).alias("b")).filter("a <> b")
    shared = materialise(met.select("token", "cls"), "jaccard-shared")
    buckets = shared.groupBy("token").agg(F.bit_xor(F.xxhash64("cls")).alias("x"), F.count(F.lit(1)).alias("n"))
    # buckets with the same classes are one
    sized = shared.join(buckets, "token").select(F.xxhash64("x", "n").alias("group"), "cls").distinct().join(classes.select("cls", F.col("n_shingles").cast("int").alias("size")), "cls")
    sized = materialise(sized.withColumn("level", size_level(F.col("size"))), "jaccard-sized")
    # a class without others in its size level or one next to it has no partner
    held = sized.groupBy("group", "level").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("n_at"))
    at = lambda k: F.coalesce(F.try_element_at("n_at", F.col("level") + k), F.lit(0))
    members = materialise(sized.join(held, "group").filter((at(0) > 1) | (at(-1) > 0) | (at(1) > 0)).select("group", "cls", "size"), "jaccard-members")
    rows = members.join(classes.select("cls", "bits"), "cls").select("group", "cls", "size", "bits")
    return connect(members, rows, F.greatest(F.col("size") / 2, F.lit(LEAST_BITS // 8)), may_link, "jaccard-may")


def components(edges: DataFrame, name: str, most: int = 40) -> DataFrame:
    """cls, root (the smallest of its component) of every end of an edge.

    Large-star and small-star steps in turn, until no edge changes: each edge then leads to its root. Before
    them each task contracts what edges it has to stars, so that a group with very many edges isn't sent on.
    """
    small_batches(edges.sparkSession)
    edges = materialise(edges, name).mapInArrow(contract, "u long, v long")
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        down = large.filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialise(small.filter("u <> v").distinct(), name)
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components of {name}: no end after {most} rounds")
    roots = edges.select(F.col("v").alias("cls")).distinct()
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("root")).unionByName(roots.select("cls", F.col("cls").alias("root")))


def apart(classes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, rows) in which no two classes, told apart by ``low`` and ``more``, have the same ``cls``: those that do are hashed again."""
    for salt in range(8):
        clash = classes.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cls")
        n = clash.count()
        if not n:
            return classes, rows
        clash = few(materialise(clash.withColumn("again", F.lit(True)), "jaccard-clash"), n)
        other = F.when(F.col("again"), F.xxhash64("low", "more", F.lit(salt))).otherwise(F.col("cls"))
        classes, rows = (materialise(d.join(clash, "cls", "left").withColumn("cls", other).select(d.columns), "jaccard-apart") for d in (classes, rows))
    raise RuntimeError("classes still share their ids")


def class_sets(docs: DataFrame, blocks: DataFrame, text: str, key: str) -> DataFrame:
    """group, cls, set of each class in ``blocks`` (group, cls, low, more, first), from the document ``first``.

    A class whose documents have no key is found among all documents without one.
    """
    named = blocks.filter("first IS NOT NULL").select("group", "cls", "low", "more", "first")
    side = few(named, blocks.count())
    src = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    wanted = src.join(side, src["id"] == side["first"]).select("group", "cls", "low", "more", "text")
    fields = [T.StructField("own_low", T.LongType()), T.StructField("own_more", T.LongType()), T.StructField("set", T.BinaryType())]

    def run(texts: pa.Array) -> list[pa.Array]:
        sets = list(shingle_sets(utf8(texts)))
        digests = [digest(s) for s in sets]
        return [pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)] + [pa.array([s.tobytes() for s in sets], pa.binary())]

    found = map_text(wanted, run, fields, "text", ["group", "cls", "low", "more"]).filter("own_low = low AND own_more = more").select("group", "cls", "set")
    nameless = map_text(src.filter("id IS NULL").select("text"), run, fields, "text", []).select(F.col("own_low").alias("low"), F.col("own_more").alias("more"), "set").dropDuplicates(["low", "more"])
    return found.unionByName(nameless.join(blocks.filter("first IS NULL").select("group", "cls", "low", "more"), ["low", "more"]).select("group", "cls", "set"))


def link_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id of every row of ``docs``.

    Letters A to Z count as lower case, words end at ASCII white space; a text of fewer than five
    words has one shingle, all its words; a null text or one without words has none, is linked
    with nothing and is its own component. ``component_id`` is the smallest key reachable by
    links; a null key is passed over unless the whole component has none. Rows that repeat a key
    are documents of their own with that key.
    """
    levels = sketch(docs, text)
    rows = materialise(described(docs, text, key, levels), "jaccard-rows").withColumn("low", F.col("cls"))
    found = rows.filter("n_shingles > 0").groupBy("low", "more").agg(F.min(key).alias("first"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bits").alias("bits"))
    classes, rows = apart(materialise(found.withColumn("cls", F.col("low")), "jaccard-classes"), rows)
    blocks = components(candidate_edges(classes, rows), "jaccard-blocks").join(classes.select("cls", "low", "more", "first", F.col("n_shingles").cast("int").alias("size")), "cls")
    blocks = materialise(blocks.select(F.col("root").alias("group"), "cls", "low", "more", "size", "first"), "jaccard-blocks")
    sets = class_sets(docs, blocks, text, key)
    found = components(connect(blocks.drop("first", "low", "more"), sets, F.col("size") * 8, do_link, "jaccard-link"), "jaccard-links")
    least = found.join(classes.select("cls", "first"), "cls")
    named = least.join(least.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("cls", "component_id")
    of_class = classes.select("cls", "first").join(named, "cls", "left").select("cls", F.coalesce("component_id", "first").alias("component_id"))
    # as a table of its own the join to the rows can split a class that many rows share
    joined = rows.select(key, "n_shingles", "cls").join(materialise(of_class, "jaccard-named"), "cls", "left")
    return joined.select(key, "n_shingles", F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.col("component_id")).alias("component_id"))
