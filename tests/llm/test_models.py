"""Language ID, BPE, lattice LM, URL rules, toxicity and the Jaccard join on small tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from driftgrove.llm import bpe, jaccard_tree, langid, lattice_lm, toxicity, url_rules

DATA = "/root/testdata/sf0.001"
RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "Ünïcode 😀 \u0000 e\u0301", "x" * 30_000, "don't  stop\n\n\t the 12345 ... ", "<|endoftext|>", "word " * 3000]


def docs_of(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({k: F.lit(v) for k, v in more.items()})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_bpe_equals_tiktoken(spark, documents):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(RANKS))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = docs_of(spark, ODD, ids="clash").unionByName(documents.select((F.col("doc_id") + 1000).alias("doc_id"), "text").withColumn("ids", F.lit("")))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=["doc_id", "ids"], decoded=True)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    for r in rows.collect():
        assert r["ids"] == own.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    back = bpe.decode(rows.drop("decoded"), RANKS, public_tokenizers.PATTERN, keep=["doc_id"])
    assert all(bytes(r["decoded"]) == texts[r["doc_id"]].encode() for r in back.collect())
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_decode_refuses_unknown_ids():
    coder = bpe.coder(RANKS, public_tokenizers.PATTERN)
    assert coder.decode([]) == b""
    for ids in ([-1], [5, len(coder.tokens)]):
        with pytest.raises(IndexError):
            coder.decode(ids)


def test_language_id(spark, documents):
    split = documents.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    filters = langid.train(split.filter("NOT held_out"))
    rows = langid.identify(split.filter("held_out"), filters, keep=["doc_id", "lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    odd = {r["doc_id"]: r for r in langid.identify(docs_of(spark, ODD, score=1, lang_pred="clash"), filters).collect()}
    assert [odd[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in odd.values())
    assert odd[3]["lang_pred"] != "und"
    unlearned = langid.train(docs_of(spark, ["a"], lang=None).withColumn("lang", F.lit(None).cast("string")))
    assert langid.identify(docs_of(spark, ["abc"]), unlearned).first()["lang_pred"] == "und"


def test_filters_find_all_members():
    r = np.random.default_rng(3)
    members = {int(g): int(m) for g, m in zip(r.integers(0, 2**62, 5000), r.integers(1, 8, 5000), strict=True)}
    f = langid.Filters.build(["a", "b", "c"], members, 1 << 15)
    got = f.masks(np.array(list(members), np.uint64))[:, 0]
    assert all(int(x) & m == m for x, m in zip(got, members.values(), strict=True))
    other = f.masks(r.integers(2**62, 2**63, 20000).astype(np.uint64))[:, 0]
    for i in range(3):
        assert abs(np.mean(other >> np.uint64(i) & np.uint64(1)) - f.false[i]) < 0.02


def test_many_languages(spark):
    """More than a word has bits: each language has three-letter words of its own."""
    code = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(2))
    rows = [(i * 10 + j, f"{code(i)}q{code(i)} " * 30, f"l{i:03d}") for i in range(200) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.train(docs)
    assert len(filters.langs) == 200 and filters.table.shape[1] == 4
    got = langid.identify(docs.select("doc_id", "text", "lang"), filters).collect()
    assert all(r["lang"] == r["lang_pred"] and r["score"] > 0.9 for r in got)


def test_language_of_texts_when_nothing_was_learned(spark):
    blank = docs_of(spark, [" ", "12"], lang="en")
    for learn in (blank, blank.limit(0)):
        got = langid.identify(docs_of(spark, ["abc", "abc"]), langid.train(learn)).collect()
        assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert langid.identify(blank.limit(0), langid.train(blank)).count() == 0


def test_language_counts_equal_plain_sets(spark, documents):
    """The filters' counts against sets of n-grams: with large filters no n-gram is a false positive."""
    texts = [r["text"] for r in documents.limit(40).collect()] + ODD
    middles = lambda t: [(c[i - 1], c[i], c[i + 1]) for c in ["".join(x if x.isalpha() else " " for x in f" {t.lower()} ")] for i in range(1, len(c) - 1) if c[i] != " "]
    packed = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))
    sets = {"a": set(middles(texts[0])), "b": set(middles(texts[1])) | set(middles(texts[2]))}
    members = {}
    for k, s in enumerate(sets.values()):
        for g in s:
            members[packed(g)] = members.get(packed(g), 0) | 1 << k
    lang, score, n = langid.Filters.build(list(sets), members, 1 << 22).predict(texts)
    for i, t in enumerate(texts):
        own = middles(t or "")
        assert n[i] == len(own)
        hits = {k: sum(g in s for g in own) for k, s in sets.items()}
        if own and hits["a"] != hits["b"]:
            assert lang[i] == max(hits, key=hits.get) and score[i] == pytest.approx(max(hits.values()) / len(own), abs=1e-3)


def all_ways(word, v, prob):
    word = "▁" + word

    def go(i):
        if i == len(word):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(word) + 1):
            p = v.prefixes.get(word[i:j], -1)
            if p >= 0:
                total += prob[p] * go(j)
        if v.prefixes.get(word[i], -1) < 0:
            total += math.prod(prob[v.byte_pieces[b]] for b in word[i].encode()) * go(i + 1)
        return total

    return go(0)


def test_lattice_sums_all_segmentations():
    v = lattice_lm.vocabulary(PIECES)
    logp = np.log(np.maximum(v.prior, lattice_lm.FLOOR)).tolist()
    prob = np.exp(logp).tolist()
    for word in ("the", "hello", "žluťoučký", "a😀b", "ation"):
        assert lattice_lm.log_likelihood(word, v, logp) == pytest.approx(math.log(all_ways(word, v, prob)), rel=1e-9)
    assert -1e7 < lattice_lm.log_likelihood("x" * 20_000, v, logp) < -1000
    for word in ("hello", "x" * 40, "a😀b"):  # the same in both forms; each letter counts once
        a, b = [0.0] * len(prob), [0.0] * len(prob)
        lattice_lm.expect(word, 2.0, v, prob, logp, a)
        short, lattice_lm.SHORT = lattice_lm.SHORT, -1
        lattice_lm.expect(word, 2.0, v, prob, logp, b)
        lattice_lm.SHORT = short
        assert a == pytest.approx(b, rel=1e-6)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    lengths = [len(sp.id_to_piece(i)) for i in range(len(prob))]
    a = [0.0] * len(prob)
    lattice_lm.expect("hello", 2.0, v, prob, logp, a)
    assert sum(x * n for x, n in zip(a, lengths, strict=True)) == pytest.approx(2.0 * 6)


def test_expected_pieces_equal_those_of_all_segmentations():
    v = lattice_lm.vocabulary(PIECES)
    prob = np.maximum(v.prior, lattice_lm.FLOOR).tolist()

    def ways(word, i=0):
        if i == len(word):
            yield ()
            return
        for j in range(i + 1, len(word) + 1):
            if (p := v.prefixes.get(word[i:j], -1)) >= 0:
                yield from ((p, *rest) for rest in ways(word, j))
        if v.prefixes.get(word[i], -1) < 0:
            yield from ((*(v.byte_pieces[b] for b in word[i].encode()), *rest) for rest in ways(word, i + 1))

    for word in ("hello", "a😀b", "station"):
        each = {w: math.prod(prob[p] for p in w) for w in ways("▁" + word)}
        want = Counter()
        for w, q in each.items():
            for p in w:
                want[p] += 3.0 * q / sum(each.values())
        for short in (22, -1):
            got, lattice_lm.SHORT, old = [0.0] * len(prob), short, lattice_lm.SHORT
            lattice_lm.expect(word, 3.0, v, prob, np.log(prob).tolist(), got)
            lattice_lm.SHORT = old
            assert {i: x for i, x in enumerate(got) if x} == pytest.approx(dict(want), rel=1e-6)


def test_expectation_of_very_unlikely_words():
    v = lattice_lm.vocabulary(PIECES)
    floor = [lattice_lm.FLOOR] * len(v.prior)
    into = [0.0] * len(floor)
    lattice_lm.expect("\U00020000\U00020001\U00020002\U00020003\ua000\ua001\ua002", 5.0, v, floor, np.log(floor).tolist(), into)
    assert np.isfinite(into).all() and sum(into) == pytest.approx(5.0 * (4 * 4 + 3 * 3 + 1))


def test_scores_of_other_documents(spark):
    model = lattice_lm.train(docs_of(spark, ["one two", "two"]).withColumn("train", F.lit(True)), PIECES, rounds=1)
    got = lattice_lm.score(docs_of(spark, ["one never", ""], n_tokens="clash"), model, head=1).orderBy("doc_id").collect()
    vocab, tens = lattice_lm.vocabulary(PIECES), math.log(10)
    end = vocab.end
    for name, logp in (("score", model.prior), ("fitted_score", model.logp)):
        want = sum(lattice_lm.log_likelihood(w, vocab, logp) for w in ("one", "never")) + logp[end]
        assert got[0][name] == pytest.approx(want / tens) and got[1][name] == pytest.approx(logp[end] / tens)
    assert [r["n_known"] for r in got] == [2, 1] and [r["n_tokens"] for r in got] == [3, 1]
    assert got[0]["base_score"] == pytest.approx(sum(math.log10((c + 0.5) / model.base_denominator) for c in (1, 0, 2)))
    assert lattice_lm.score_held_out(docs_of(spark, []), PIECES).count() == 0


@pytest.mark.parametrize("head", [lattice_lm.HEAD, 3])
def test_lattice_scores(spark, documents, head):
    docs = documents.select("doc_id", "text").limit(60).unionByName(docs_of(spark, [None, "", "Zzyzx qqq"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = docs.collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    split = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1)
    model = lattice_lm.train(split.withColumn("train", ~F.col("held_out")), PIECES, rounds=1)
    got = lattice_lm.score(split, model, head=head).collect()
    tok = lambda t: (t or "").encode().lower().split()
    counts = Counter(w for r in rows if not held(r["doc_id"]) for w in tok(r["text"]))
    ends = sum(not held(r["doc_id"]) for r in rows)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    vocab, memo = lattice_lm.vocabulary(PIECES), {}
    want = []
    for r in rows:
        words = tok(r["text"])
        both = [memo.setdefault(w, lattice_lm.log_likelihoods(w.decode(), vocab, (model.prior, model.logp))) for w in words]
        lp, fit = (sum(x[i] for x in both) + logp[vocab.end] for i, logp in enumerate((model.prior, model.logp)))
        want.append((len(words) + 1, sum(w in counts for w in words) + 1, sum(base(counts[w]) for w in words) + base(ends), lp / math.log(10), fit / math.log(10)))
    assert model.n == n and model.v == v
    mine = sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"], r["fitted_score"]) for r in got)
    assert len(mine) == len(want)
    for a, b in zip(mine, sorted(want), strict=True):
        assert a == pytest.approx(b, rel=1e-9)


def test_fitting_makes_held_out_texts_likelier(spark, documents):
    docs = documents.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).alias("held_out"))
    split = docs.withColumn("train", ~F.col("held_out"))
    total = []
    for rounds in (0, 1, 2):
        rows = lattice_lm.score(docs, lattice_lm.train(split, PIECES, rounds=rounds)).filter("held_out")
        total.append(rows.agg(F.sum("fitted_score")).first()[0])
    assert total[0] < total[1] < total[2]


def test_model_of_the_corpus(spark, documents):
    """Held-out texts are about as likely as under word counts, and every score is the sum of its tokens' own."""
    docs = documents.select("doc_id", "text").unionByName(docs_of(spark, [None, "", "\ufffe" * 3000]).withColumn("doc_id", F.lit(-1).cast("long") - F.col("doc_id")))
    rows = lattice_lm.score_held_out(docs, PIECES).select("held_out", "base_score", "score").collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and sum(r["score"] for r in held if r["base_score"] > -5000) > 1.5 * sum(r["base_score"] for r in held if r["base_score"] > -5000)
    split = docs_of(spark, ["one two", "two three three three", "two", None]).withColumn("train", F.lit(True))
    for once in (False, True):
        for head in (0, 100):
            model = lattice_lm.train(split, PIECES, rounds=1, once=once)
            got = lattice_lm.score(docs_of(spark, ["one never two", "", "q" * 4000]), model, head=head).orderBy("doc_id").collect()
            counts = {"one": 1, "two": 3, "three": 3, "": 4}  # the end is a token
            n, vocab = 11, lattice_lm.vocabulary(PIECES)
            assert (model.n, model.v, model.discount) == (n, 4, 0.95)

            def own(word, counts=counts, model=model, n=n, vocab=vocab):
                fit = lattice_lm.log_likelihood(word, vocab, model.logp) if word else model.logp[vocab.end]
                c = counts.get(word, 0)
                if not c:
                    return math.log10(0.95 * 4 / n) + fit / math.log(10)
                return math.log10((c - 0.95) / n + 0.95 * 4 / n * math.exp(fit))

            want = [sum(map(own, words)) for words in (["one", "never", "two", ""], [""], ["q" * 4000, ""])]
            assert [r["model_score"] for r in got] == pytest.approx(want)
    nothing = lattice_lm.score(docs_of(spark, ["one", None]), lattice_lm.train(split.filter("NOT train"), PIECES)).orderBy("doc_id").collect()
    assert [r["model_score"] for r in nothing] == pytest.approx([r["fitted_score"] for r in nothing])


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/1", "https://example.com/en/x", "http://a.example.com/fr/", "http://x.com", "http://b.net/es/1", "http://b.net/de/1", "http://adult-x.example.net/en/1", "http://badult.example.org/en/", "no scheme", None, "", "http://1.2.3.4/x", "x://h?/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en/x", "example.com/en/", "block"), ("a.example.com", "/fr/", "com/", "allow"), ("x.com", "", None, "allow"),
        ("b.net", "/es/1", "net/es/", "block"), ("b.net", "/de/1", None, "allow"), ("adult-x.example.net", "/en/1", None, "block"), ("badult.example.org", "/en/", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("1.2.3.4", "/x", None, "block"), ("h", "", None, "allow"),
    ]


def test_candidates_lose_no_match(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url")
    patterns = (*url_rules.PATTERN_RULES, r"\ben\b/\d+\.html$", r"(\bde\b|\bfr\b)/7", r"x=\d|feed", r"\bref\b=x(#top)?")
    assert url_rules.literal_tokens(r"(\ba\b|b)\bc\b-\bd\b?[\be\b]") == ["c"] or url_rules.literal_tokens(r"(\ba\b|b)\bc\b") == ["c"]
    got = {r["page_id"]: r["pattern"] for r in url_rules.match_patterns(pages, patterns).collect()}
    for r in pages.collect():
        assert got[r["page_id"]] == next((p for p in patterns if re.search(p, r["url"].lower(), re.A)), None)


def test_literal_tokens():
    tokens = url_rules.literal_tokens
    assert tokens(r"(\ba\b|b)\bc\b-\bd\b?[\be\b]") == ["c"]
    assert tokens(r"a\\bfoo\b") == [] and tokens(r"\\\bfoo\b") == ["foo"] and tokens(r"\bfoo?\b") == [] and tokens(r"\bfoo\b{2}") == []
    assert tokens(r"[^]\b]x\b\bfoo\b") == ["foo"] and tokens(r"[\]|]\bfoo\b") == ["foo"] and tokens("[a") == [] and tokens(r"\bfoo\b|x") == []
    assert tokens(r"(?x) # \bfoo\b") == [] and tokens(r"\bfo(o)\b \bbar\b/\bbaz\b") == ["bar", "baz"]


def test_rules_by_token_find_what_all_rules_find(spark):
    """Random patterns of escapes, classes, groups and quantifiers against running each of them on each URL."""
    r = np.random.default_rng(17)
    bits = [r"\b", r"\b", "foo", "b", "x1", r"\\", "[ab/]", "[^]x]", "(?:foo)", "(b|x1)", r"\.", "-", r"\bfoo\b", r"\bb\b", "/"]
    marks = ["", "", "", "?", "*", "+", "{1,2}"]
    patterns = []
    while len(patterns) < 300:
        p = "".join(str(r.choice(bits)) + str(r.choice(marks)) for _ in range(r.integers(1, 6))) + ("|x1" if r.random() < 0.1 else "")
        try:
            re.compile(p)
            patterns.append(p)
        except re.error:
            pass
    urls = ["".join(r.choice(["foo", "b", "x1", "\\", "/", "-", ".", "a", "]", "X1", "_"], r.integers(1, 8)).tolist()) for _ in range(300)] + ["http://a\\bfoo/x"]
    compiled = [re.compile(p, re.ASCII) for p in patterns]
    lower = str.maketrans(url_rules.UPPER, url_rules.LOWER)
    want = {i: next((p for p, c in zip(patterns, compiled, strict=True) if c.search(u.translate(lower))), None) for i, u in enumerate(urls)}
    rows = url_rules.match_patterns(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), patterns)
    assert {x["page_id"]: x["pattern"] for x in rows.collect()} == want
    for i, p in enumerate(patterns):  # each alone, as the first match hides the others
        assert all(t in set(re.split("[^a-z0-9]+", u.translate(lower))) for t in url_rules.literal_tokens(p) for u in urls if compiled[i].search(u.translate(lower)))


def test_classes_with_equal_ids_are_kept_apart(spark, monkeypatch):
    """Digests whose first halves are all one of three numbers: classes must not merge."""
    real = jaccard_tree.digest
    texts = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(40)] + [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(10)] + ["w3x0 " + " ".join(f"w3x{j}" for j in range(12))]
    docs = docs_of(spark, texts)
    want = {r["doc_id"]: r["component_id"] for r in jaccard_tree.link_components(docs).collect()}
    sets = jaccard_tree.described

    def same(*args):
        return sets(*args).withColumn("cls", F.pmod("cls", F.lit(3)))

    monkeypatch.setattr(jaccard_tree, "described", same)
    monkeypatch.setattr(jaccard_tree, "digest", lambda s: (real(s)[0] % 3, real(s)[1]))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_tree.link_components(docs).collect()}
    assert got == want and len(set(got.values())) == 40


def test_many_url_rules(spark):
    r = np.random.default_rng(2)
    names = [f"host{i}" for i in range(3000)]
    patterns = [rf"\b{a}\b.*\b{b}\b" for a, b in r.choice(names, (5000, 2))] + [r"x{9}"]
    urls = [f"http://{'.'.join(r.choice(names, 4))}/{'/'.join(r.choice(names, 9))}" for _ in range(150)]
    urls += [f"http://{p[2:-2].replace(chr(92) + 'b.*' + chr(92) + 'b', '/')}/" for p in patterns[:50]] + [None, "", "http://X/xxxxXXxxx"]
    pages = spark.createDataFrame([(i % 100, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, pattern string").repartition(3)
    got = url_rules.match_patterns(pages, patterns, keep=["page_id", "url", "pattern"]).collect()
    every = [re.compile(p, re.A) for p in patterns]
    for x in got:
        hit = next((i for i, p in enumerate(every) if x["url"] and p.search(x["url"].lower())), None)
        assert x["pattern"] == (None if hit is None else patterns[hit])
    assert sum(x["pattern"] is not None for x in got) >= 51
    assert url_rules.judge(pages.limit(0)).count() == 0 and len(got) == len(urls)


def naive_logit(cnn, text):
    """The network by plain loops over words, filters and places."""
    words = [toxicity.word_features(w) for w in toxicity.words_of(text)]
    x = [cnn.embed[f].sum(0) for f in words] + [np.zeros(toxicity.DIM)] * max(0, max(toxicity.WIDTHS) - len(words))
    total, n = cnn.out_bias, 0
    for w, filters in zip(toxicity.WIDTHS, cnn.filters, strict=True):
        for k in range(toxicity.FILTERS):
            best = max(sum(float(x[i + j] @ filters[j, :, k]) for j in range(w)) for i in range(len(x) - w + 1))
            total += max(0.0, best + float(cnn.bias[n])) * float(cnn.out[n])
            n += 1
    return total


def test_network_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 7)
    cnn = toxicity.Cnn.fresh(3)
    texts = ["one two three one two", "", None, "a", "the quick brown fox jumps over the lazy dog and the fence " * 3]
    assert cnn.logits(texts) == pytest.approx([naive_logit(cnn, t) for t in texts], rel=1e-4, abs=1e-5)


def test_gradients_equal_differences():
    cnn = toxicity.Cnn.fresh(11)
    texts, labels, up = ["bad words here now", "some good words", "x"], [1, 0, 1], 2.0
    words = sorted({w for t in texts for w in toxicity.words_of(t)})
    table = np.array([[0] * (1 + len(toxicity.BEGINNINGS))] + [toxicity.word_features(w) for w in words])
    docs = [np.array([words.index(w) + 1 for w in toxicity.words_of(t)]) for t in texts]
    for k, x in enumerate(cnn.filters):
        cnn.filters[k] = x.astype(np.float64)
    cnn.embed, cnn.bias, cnn.out = cnn.embed.astype(np.float64), cnn.bias.astype(np.float64) + 0.1, cnn.out.astype(np.float64)
    grads, g_bias, g_out, g_c, rows, steps = cnn.gradients(table, docs, labels, up)

    def loss():
        z = [naive_logit(cnn, t) for t in texts]
        return sum((up if y else 1.0) * math.log1p(math.exp(-x if y else x)) for x, y in zip(z, labels, strict=True))

    def slope(array, at):
        old, h = array[at], 1e-4
        array[at] = old + h
        high = loss()
        array[at] = old - h
        low = loss()
        array[at] = old
        return (high - low) / (2 * h)

    r = np.random.default_rng(0)
    for array, g in [*zip(cnn.filters, grads, strict=True), (cnn.bias, g_bias), (cnn.out, g_out)]:
        for _ in range(6):
            at = tuple(int(r.integers(n)) for n in array.shape)
            assert g[at] == pytest.approx(slope(array, at), rel=1e-2, abs=1e-4)
    embed = np.zeros_like(cnn.embed)
    np.add.at(embed, rows, steps[:, None, :])
    for f in (table[1][0], table[2][1], table[-1][0]):
        assert embed[f] == pytest.approx([slope(cnn.embed, (f, i)) for i in range(toxicity.DIM)], rel=1e-2, abs=1e-4)
    old = cnn.out_bias
    cnn.out_bias = old + 1e-4
    high = loss()
    cnn.out_bias = old - 1e-4
    assert g_c == pytest.approx((high - loss()) / 2e-4, rel=1e-3)


def test_toxicity_of_odd_tables(spark):
    docs = docs_of(spark, ["bad", "good", None, "bad"], lang="en").withColumn("doc_id", F.col("doc_id") % 3)
    marks = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert toxicity.score(docs, model).count() == 4 and toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), marks).cnn is None


def test_toxicity(spark):
    r = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = list(r.choice(words, r.integers(5, 60)))
        bad = i % 5 == 0
        if bad:
            text[int(r.integers(len(text)))] = str(r.choice(["nastyone", "nastytwo", "vilest"]))
        rows.append((i, " ".join(text), "en" if i % 2 else "fr"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs.filter("doc_id % 3 <> 1"), marks)
    got = {x["doc_id"]: x for x in toxicity.score(docs, model, keep=["doc_id", "score"]).collect()}
    held = [i for i in range(900) if i % 3 == 1]
    right = sum(got[i]["predicted"] == labels[i][1] for i in held)
    assert right >= 0.97 * len(held) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got.values())
    odd = toxicity.score(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= x["score"] <= 1 for x in odd)
    assert {x["score"] for x in toxicity.score(docs_of(spark, ["a"]), toxicity.train(docs, marks.limit(0))).collect()} == {0.0}


def test_word_hashes_tell_words_apart():
    line = "a"
    while len(line) < 1024:  # Thue-Morse words and their complements collide under polynomials modulo 2**64
        line += line.translate({97: 98, 98: 97})
    words = [line, line.translate({97: 98, 98: 97}), line[:64], line[:65], line[1:65], line[:9], line[:8], line[1:9], "é" * 40, "é" * 41]
    r = np.random.default_rng(1)
    words += ["".join(r.choice(list("abc"), n)) for n in r.integers(1, 80, 3000)]
    text = " \t".join(words).encode() + b"\n"
    begin, h = jaccard_tree.word_hashes(np.frombuffer(text, np.uint8))
    assert len(begin) == len(words) and len(set(h.tolist())) == len(set(words))
    assert dict(zip(words, h.tolist(), strict=True)) == dict(zip(words, jaccard_tree.word_hashes(np.frombuffer(text.upper().replace("É".encode(), "é".encode()), np.uint8))[1].tolist(), strict=True))


def linked(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join_is_exact(spark, monkeypatch, seed, small):
    if small:  # groups are cut into chunks, leaves are small, and the ids aren't broadcast
        for name, value in (("MAX_CLASSES", 3), ("MAX_PAIRS", 2 + seed), ("LEAF", 2), ("MAX_BROADCAST", 0)):
            monkeypatch.setattr(jaccard_tree, name, value)
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(900, None), (901, ""), (902, "one two"), (903, "ONE\ttwo"), (904, "one two three four five"), (None, "one two"), (905, " \n")]
    for g in range(14):
        base = list(r.choice(words, r.integers(3, 90)))
        for _ in range(int(r.integers(1, 9))):
            text = list(base)
            for _ in range(int(r.integers(0, 3))):
                text[int(r.integers(len(text)))] = str(r.choice(words))
            rows.append((len(rows), " ".join(text[: len(text) - int(r.integers(0, 4))])))
    passage = " ".join(r.choice(words, 30))
    rows += [(500 + i, f"{passage} {' '.join(r.choice(words, 12))}") for i in range(12)] + [(500, rows[8][1]), (None, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("clash")).withColumn("text2", F.lit("x")).repartition(3)
    got = sorted((tuple(x) for x in jaccard_tree.link_components(docs).collect()), key=repr)
    assert got == linked(rows)


def test_edges_are_contracted(spark, monkeypatch):
    """Edges of a group of any density become stars, and overlapping groups have the same ones."""
    dense = [(a, b) for a in range(60) for b in range(a)] + [(101, 100), (102, 101), (7, 7)]
    assert sorted(jaccard_tree.stars(dense)) == [(x, 0) for x in range(1, 60)] + [(101, 100), (102, 100)]
    assert jaccard_tree.stars([]) == []
    batch = jaccard_tree.edge_batch(dense[:-1])
    monkeypatch.setattr(jaccard_tree, "MOST_EDGES", 50)
    parts = [r for b in jaccard_tree.contract([batch.slice(i, 40) for i in range(0, batch.num_rows, 40)]) for r in zip(*b.to_pydict().values(), strict=True)]
    assert len(parts) < len(dense) and sorted(jaccard_tree.stars(parts)) == sorted(jaccard_tree.stars(dense))
    edges = spark.createDataFrame(dense[:-1] * 3 + [(1000 - i, 999 - i) for i in range(50)], "u long, v long").repartition(5)
    got = {tuple(r) for r in jaccard_tree.components(edges, "test-dense").collect()}
    assert got == {(x, 0) for x in range(60)} | {(x, 100) for x in (100, 101, 102)} | {(x, 950) for x in range(950, 1001)}


def test_jaccard_join_of_nothing(spark):
    assert jaccard_tree.link_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = jaccard_tree.link_components(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).collect()
    assert [tuple(x) for x in one] == [(7, 2, 7)]


def test_pipeline_keeps_rows_and_columns_apart(spark):
    import corpus_pipeline as cp

    r = np.random.default_rng(4)
    text = lambda n: " ".join(r.choice("alpha beta gamma delta the of and house green over under".split(), n))
    base = text(80)
    rows = [(1, base), (5, base + " end"), (5, text(80)), (None, base + " stop"), (None, text(60)), (7, None), (8, ""), (8, ""), (9, "12 34"), (1, base), (10, "alpha")]
    docs = spark.createDataFrame([(i, t, "en", None if i == 5 else "src0", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("score", "lang_pred", "n_grams", "rate", "n_copies", "copy_no", "shuffle_key", "text2", "cls", "digest")})
    left = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA)
        assert stage(spark, docs.limit(0), DATA).count() == 0
        if name != "byte_bpe":
            assert out.columns == docs.columns
            got = out.collect()
            assert all(x[c] == f"own {c}" for x in got for c in docs.columns[5:])
            left[name] = sorted((x["n_chars"] for x in got))
            docs = spark.createDataFrame(got, docs.schema)
    assert left["language_id"] == [0, 1, 2, 3, 4, 9, 10]  # those without a letter go
    assert len(left["exact_dedup"]) == 6 and set(left["exact_dedup"]) | {0} == {0, 1, 2, 3, 4, 10} or set(left["exact_dedup"]) == {9, 1, 2, 3, 4, 10}
    near = set(left["jaccard_join"])
    assert {2, 4, 10} <= near and len(near) == 4 and near & {0, 9}  # the other text with id 5 stays
    final = out.collect()
    assert all(x["decodes"] for x in final)


def test_pipeline(spark, documents):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "source_mix", "byte_bpe"]
    docs, seen = documents, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA)
        if name != "byte_bpe":
            assert out.columns == documents.columns
        seen[name] = out = spark.createDataFrame(out.collect(), out.schema)
        docs = out
    assert seen["language_id"].count() >= 0.98 * documents.count()
    texts = [re.sub("[\x20\x09-\x0d]", "", r["text"]) for r in seen["exact_dedup"].collect()]
    assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0d]", "", r["text"]) for r in seen["language_id"].collect()})
    left = [(r["doc_id"], r["text"]) for r in seen["jaccard_join"].collect()]
    assert {d for d, _ in left} == {c for _, _, c in linked([(r["doc_id"], r["text"]) for r in seen["exact_dedup"].collect()])}
    final = seen["byte_bpe"].collect()
    assert len(final) == seen["source_mix"].count() and all(r["decodes"] for r in final)


def test_near_duplicates_drop_rows_not_ids(spark):
    import corpus_pipeline

    copy = " ".join(f"w{i}" for i in range(40))
    rows = [(1, copy), (2, copy + " x"), (2, "another text that is clean and stays here"), (None, copy + " y"), (None, "a lone text without an id that stays")]
    rows += [(None, "b " + copy.replace("w", "v")), (None, "c " + copy.replace("w", "v")), (7, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    nameless = [t for d, t in left if d is None and t and "v1" in t]
    assert len(nameless) == 1
    assert sorted([r for r in left if r[1] not in nameless], key=repr) == sorted([rows[0], rows[2], rows[4], rows[7], rows[8]], key=repr)


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows than the 6,000 that it was once fitted on: each is in a shard, for weights or for thresholds."""
    n, seen = 8000, {"held": 0}

    def fit(shards, cnn, up):
        seen.update(fit=shards.filter(lambda r: not r["held"]).count(), shards=shards.getNumPartitions(), up=up)
        return cnn

    def threshold(values, toxic, rows):
        seen["held"] = max(seen["held"], int(rows.sum()))
        return 0.0

    monkeypatch.setattr(toxicity, "fit_shards", fit)
    monkeypatch.setattr(toxicity, "best_threshold", threshold)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "vile word").otherwise("kind word").alias("text"), F.lit("en").alias("lang"))
    toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    assert seen["fit"] + seen["held"] == n and seen["held"] == pytest.approx(n / toxicity.CALIBRATE, rel=0.1)
    assert seen["shards"] == 2 and seen["up"] == pytest.approx(3, rel=0.1)


def test_toxicity_of_shards(spark):
    """What several shards learn together tells texts apart, and is the same again."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "some vile word").otherwise("some kind word").alias("text"), F.lit("en").alias("lang"))
    marks = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model, again = toxicity.train(docs, marks, shard=100), toxicity.train(docs.repartition(3), marks, shard=100)
    assert all(x["predicted"] == int(x["doc_id"] % 4 == 0) for x in toxicity.score(docs, model).collect())
    assert np.array_equal(model.cnn.embed, again.cnn.embed) and model.thresholds == again.thresholds


def test_languages_of_all_rows_by_words(spark):
    """Counting n-grams once for each distinct word makes the filters that counting them in the texts makes; so does telling a text."""
    texts = ["Déjà vu, déjà-vu 3x4 a_b", "İstanbul ΣΑΣ ²x½ ", "", "the end, the end", "日本語 テキスト"] * 3
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    by_text, by_word = langid.train(docs, sample_rows=10**9), langid.train(docs, sample_rows=None)
    assert by_text.langs == by_word.langs and np.array_equal(by_text.table, by_word.table)
    told = toxicity.Classifier(None, by_word, {})
    assert told.language([*texts, None]) == by_word.predict([*texts, None])[0]


def test_toxicity_moves_labelled_texts_once(spark):
    """Texts without a label stay where they are, none with one is lost, and no join exchanges texts."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    marks = docs.filter("doc_id % 50 = 0").select("doc_id", F.lit(1).alias("toxic"))
    near = toxicity.may_have(docs, marks, 100 * toxicity.BITS)
    ids = {r["doc_id"] for r in near.collect()}
    assert {r["doc_id"] for r in marks.collect()} <= ids and len(ids) < 800 and near.columns == docs.columns
    shards = toxicity.labelled(docs, marks, F.col("doc_id") % 2 / 2.0, 2, F.col("doc_id") % 100 == 0)
    assert sorted((r["doc_id"], r["toxic"], r["held"]) for r in shards.collect()) == [(i, 1, i % 100 == 0) for i in range(0, 5000, 50)]


def test_changes_of_weights_are_small():
    """A shard that changes a tenth of its embeddings sends far less than their size, and loses nothing."""
    r = np.random.default_rng(2)
    moved = np.where(r.random((toxicity.BUCKETS, 1)) < 0.1, np.rint(r.normal(0, 0.01, (toxicity.BUCKETS, toxicity.DIM)) * toxicity.FIXED), 0).astype(np.int64)
    packed = toxicity.pack([moved, np.array([1 << 40])])
    assert len(packed) < moved.size and all(np.array_equal(x, y) for x, y in zip(toxicity.unpack(packed), [moved, np.array([1 << 40])], strict=True))


def test_logits_of_texts_together(monkeypatch):
    """Texts of any length, many together, a few at a time, or in pieces: the same scores as by plain loops."""
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(["ab", "cde", "fghi", "jk", "l"], n)) for n in r.integers(0, 9, 40)]
    cnn = toxicity.Cnn.fresh(3)
    right = [naive_logit(cnn, t) for t in texts]
    for piece, group, cache in ((50, 11, 4), (10**6, 10**6, 10), (1, 1, 1)):
        for name, value in (("PIECE", piece), ("GROUP", group), ("CACHE", cache)):
            monkeypatch.setattr(toxicity, name, value)
        cnn.kept = None
        assert cnn.logits(texts) == pytest.approx(right, rel=1e-4, abs=1e-5)
    assert not len(cnn.logits([])) and cnn.logits([None, ""]) == pytest.approx([naive_logit(cnn, "")] * 2, rel=1e-4, abs=1e-5)


def test_features_of_words_together():
    words = ["a", "ab", "abc", "abcdefghi", "abcdefghijklmnop", "straße", "日本語テキスト", "日本語テキスト日本語テキスト", "é" * 12, "𐐨𐐩𐐪𐐫𐐬𐐭𐐮𐐯𐐰𐐱", "aé日𐐨bcdefg", "ab\ud800c"]
    assert toxicity.features(words).tolist() == [toxicity.word_features(w) for w in words]
    assert toxicity.features([]).shape == (0, 1 + len(toxicity.BEGINNINGS))


def test_toxicity_of_shards_makes_all_passes(spark, monkeypatch):
    """Several shards go over all their rows as often as a single one; they once made half the passes."""
    seen, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: seen.append(x) or broadcast(x))
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "some vile word").otherwise("some kind word").alias("text"), F.lit("en").alias("lang"))
    toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")), shard=30)
    assert sum(isinstance(x, tuple) and isinstance(x[0], toxicity.Cnn) for x in seen) == toxicity.EPOCHS


def test_gradients_of_texts_together(monkeypatch):
    """Short texts of a step go through together, long ones each in pieces, with the same places and gradients."""
    cnn, texts = toxicity.Cnn.fresh(5), ["b a b a b", "", "one", "a long text of several words and a long text of several words", "x y"]
    rows = toxicity.Prepared.of(texts, [1, 0, 1, 0, 0])
    together = cnn.gradients(rows.table, rows.docs(), rows.labels, 2.0)
    monkeypatch.setattr(toxicity, "PIECE", 4)
    apart = cnn.gradients(rows.table, rows.docs(), rows.labels, 2.0)
    for x, y in zip((*together[0], *together[1:]), (*apart[0], *apart[1:]), strict=True):
        assert np.allclose(x, y, rtol=1e-5, atol=1e-7)
    one = [cnn.gradients(rows.table, [d], [y], 2.0) for d, y in zip(rows.docs(), rows.labels, strict=True)]
    for k in range(len(toxicity.WIDTHS)):
        assert np.allclose(sum(x[0][k] for x in one), together[0][k], rtol=1e-4, atol=1e-6)


def test_judge_is_language_and_logit(monkeypatch):
    """A word looked up once for both gives what either gives alone, also for texts longer than a piece."""
    by_word = langid.Filters.build(["a", "b"], {int(g): 1 + k % 3 for k, g in enumerate(langid.grams([" red dog has big feet "])[0])})
    texts = ["red dog", "", None, "123", "big feet has red dog " * 9, "dog"]
    told = toxicity.Classifier(toxicity.Cnn.fresh(3), by_word, {"": 0.0})
    for piece in (10**6, 20):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        told.kept = told.cnn.kept = None
        langs, z = told.judge(texts)
        assert langs == by_word.predict(texts)[0] and z == pytest.approx(told.cnn.logits(texts), rel=1e-5, abs=1e-6)
