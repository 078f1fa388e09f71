"""Chat examples, lexical search and spelling variants against plain Python on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrove.llm import chat, lexical, spelling

DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def rendered(turns):
    esc = lambda s: re.sub(r"<(\\*)\|", r"<\1\\|", s)
    return ["<|im_start|>" + esc(r.replace("\\", "\\\\").replace("\n", "\\n")) + "\n" + esc(t) + "<|im_end|>\n" for r, t in turns]


def expected_report(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    own = [t for r, t in turns if r == "assistant"]
    parts = rendered(turns)
    ends = np.cumsum([len(p) for p in parts])
    whole = sum(int(e) - len("<|im_end|>\n") for e, (r, _) in zip(ends, turns, strict=True) if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, own)), sha("".join(own)), sum(map(len, parts)), len(own), whole


def conversations(rows):
    out = {}
    for c, _, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        out.setdefault(c, []).append((r or "", t or ""))
    return out


ODD = [
    (1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"),
    (2, 0, "user", None), (2, 1, None, "x"), (2, None, "assistant", ""), (2, 1, None, "x"), (2, 5, "assistant", "<"), (2, 6, "assistant", "|im_end|>\n"),
    (3, 0, "system", "no answer"), (None, 0, "assistant", "<\\|a <\\\\| \\| <<|"), (None, 9, "a\\b\nc<|", "é😀"),
    (4, 0, "user", "u" * 70_000), (4, 1, "assistant", "<|" * 30_000), (4, 2, "user", "z"), (4, 3, "assistant", "end"), *[(5, i, "user" if i % 2 else "assistant", f"turn {i} " + "w" * 900) for i in range(2100)],
]


def test_chat_reads_back_whole_conversations(spark):
    rows = spark.createDataFrame(ODD, TURNS).withColumn("page", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r["id"]: tuple(r)[1:] for r in chat.read_back(chat.format_conversations(rows)).collect()}
    assert got == {c: expected_report(t) for c, t in conversations(ODD).items()}
    empty = chat.format_conversations(rows.limit(0))
    assert chat.read_back(empty).count() == 0 and empty.examples.count() == 0


def test_chat_examples_hold_all_turns_before(spark):
    small = [r for r in ODD if r[0] != 5] + [(5, i, "user" if i % 2 else "assistant", "v" * 9000) for i in range(12)]
    found = chat.format_conversations(spark.createDataFrame(small, TURNS))
    got = sorted((r["key"]["id"] if r["key"]["id"] is not None else -9, r["n_context"], r["text"], r["text"][r["loss_start"] : r["loss_end"]]) for r in chat.expanded(found).collect())
    want = []
    for c, turns in conversations(small).items():
        parts = rendered(turns)
        for i, (r, _) in enumerate(turns):
            if r == "assistant":
                head, body = parts[i].split("\n", 1)
                reply = body[: -len("<|im_end|>\n")]
                want.append((-9 if c is None else c, i, "".join(parts[:i]) + head + "\n" + reply, reply))
    assert got == sorted(want)
    assert max(len(r["context"]) for r in found.examples.collect()) <= chat.PAGE and max(len(r["text"]) for r in found.pages.collect()) <= chat.PAGE
    assert found.examples.filter("shared_pages > 0").count() > 3


def test_chat_report_reads_whole_prefixes(spark):
    small = [(5, i, "user" if i % 2 else "assistant", f"{i} " + "v" * 9000) for i in range(12)] + [(6, 0, "user", "a"), (6, 1, "assistant", "b<|c")]
    found = chat.format_conversations(spark.createDataFrame(small, TURNS))
    texts, loss = {}, {}
    for r in sorted(chat.expansion(found).collect(), key=lambda r: r["start"]):
        at = (r["key"]["id"], r["n_context"])
        assert len(texts.get(at, "")) == r["start"] and len(r["text"]) < 2 * chat.PAGE
        texts[at], loss[at] = texts.get(at, "") + r["text"], (r["loss_start"], r["loss_end"])
    whole = {(r["key"]["id"], r["n_context"]): r["text"] for r in chat.expanded(found).collect()}
    assert texts == whole and all(len(texts[at]) == end for at, (_, end) in loss.items())
    # what an example lacks, the report lacks
    bare = chat.Formatted(found.pages, found.examples.withColumn("context", F.lit("")))
    lost = {r["id"]: r["expanded_chars"] for r in chat.read_back(bare).collect()}
    assert all(lost[c] < sum(len(t) for (k, _), t in whole.items() if k == c) for c in (5, 6))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    df = Counter(w for _, b in bags for w in b)
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        hits = []
        for i, b in bags:
            m = 100 - 90 + 90 * sum(b.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w in terms if w in b)
            if score > 0:
                hits.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, h[3], -h[0]) for rank, h in enumerate(sorted(hits)[:k])]
    return sorted(out, key=repr)


def test_search_equals_scoring_every_document(spark, monkeypatch):
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Émile", "x y", "ÄB"]
    share = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(r.choice(words, n, p=share / share.sum()))
    docs = [(i, text(int(r.integers(1, 60)))) for i in range(400)] + [(7, text(9)), (None, text(30)), (None, "w3"), (900, None), (901, ""), (902, " .,"), (903, "W1 " * 9000), (-4, "w2 w2"), (2**40, "w5,w9")]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]
    items = [(i, text(int(r.integers(1, 25)))) for i in range(30)] + [(3, "w1"), (None, "w2 é"), (50, None), (51, "..."), (52, "nowhere"), (53, docs[3][1])]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("term", F.lit("clash")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    index = lexical.build_index(rows)
    assert [tuple(x) for x in sorted(lexical.search(index, asked, 7).collect(), key=lambda x: repr(tuple(x)))] == ranked(docs, items, 7)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 10)  # several blocks
    assert sorted(map(tuple, lexical.search(index, asked, 3).collect()), key=repr) == ranked(docs, items, 3)
    none = lexical.build_index(rows.limit(0))
    assert none.count() == 0 and lexical.search(none, asked).count() == 0 and lexical.search(index, asked.limit(0)).count() == 0


def test_shards_are_searched_with_pruning():
    """Small shards one after the other, the heap going from one to the next."""
    import pyarrow as pa

    r = np.random.default_rng(8)
    docs = [(int(i), " ".join(f"t{min(int(x), 40)}" for x in r.zipf(1.4, int(r.integers(1, 40))))) for i in r.permutation(600)]
    bags = {i: Counter(t.split()) for i, t in docs}
    df = Counter(w for b in bags.values() for w in b)
    n, total = len(docs), sum(sum(b.values()) for b in bags.values())
    queries = [[f"t{x}" for x in sorted(set(r.integers(1, 41, 9).tolist()))] for _ in range(20)]
    heaps = [[] for _ in queries]
    for at in range(0, 600, 50):
        part = docs[at : at + 50]
        found, lengths = lexical.terms_of(pa.array([t for _, t in part]))
        rows = lexical.shard_rows(0, pa.array([i for i, _ in part]), found, lengths).to_pylist()
        shard = lexical.Shard(rows[-1]["ids"], rows[-1]["lengths"], n, total)
        for row in rows[:-1]:
            if w := lexical.weight(n, df[row["term"]]):
                shard.add(row["term"], w, row["postings"])
        for q, heap in zip(queries, heaps, strict=True):
            shard.search(q, 5, heap)
    got = sorted(((i, rank + 1, -x[2], x[0]) for i, h in enumerate(heaps) for rank, x in enumerate(sorted(h, reverse=True))), key=repr)
    assert got == ranked(docs, [(i, " ".join(q)) for i, q in enumerate(queries)], 5)


def test_varints():
    v = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**40])
    data, ends = lexical.varints(v)
    assert lexical.values_of(data.tobytes()).tolist() == v.tolist() and len(data) == ends[-1]
    assert lexical.values_of(b"").tolist() == [] and lexical.varints(np.array([], np.int64))[0].tolist() == []


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [form, n, len(close), counts[form] if form else None]
    rows = set()
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        rows.add((w, out[w][0], at, *out[w][1:]))
    return rows


def test_variants_equal_all_pairs(spark):
    r = np.random.default_rng(11)
    counts = {"aaaaa": 3, "aaaaaa": 7, "aaaaaaa": 20, "abaaa": 3, "ababab": 5, "bababa": 9, "ababa": 40, "ÿÀ×÷ß": 3, "ÿÀ×÷": 90, "a": 4, "b": 9, "ab": 99, "z" * 3000: 3, "z" * 2999: 8}
    for _ in range(900):
        w = "".join(r.choice(list("abcé"), int(r.integers(5, 9))))
        counts[w] = int(r.integers(3, 60))
    words = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long").withColumn("form", F.lit("clash"))
    got = spelling.variants(words.select("word", "n"))
    assert {(x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in got.collect()} == plain_variants(counts)
    assert got.count() == len(counts) and spelling.variants(words.select("word", "n").limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(words, 1)


def test_differences_of_powers_are_distinct():
    powers = [i**spelling.POWER for i in range(1, 91)]
    gaps = [a - b for a in powers for b in powers if a != b]
    assert len(set(gaps)) == len(gaps) and not set(gaps) & set(powers)


def test_words_of_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()] + [(None, "Straße Straße straße"), (5, None), (6, ""), (7, "a1b2 __"), (8, "ÀÉ" * 9000)]
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("h", F.lit(0))
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = spelling.vocabulary(spelling.slipped(spelling.runs(rows)))
    assert {r["word"]: r["n"] for r in got.collect()} == want
    assert {(x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling.group_variants(rows).collect()} == plain_variants(want)
    assert spelling.group_variants(rows.limit(0)).count() == 0
