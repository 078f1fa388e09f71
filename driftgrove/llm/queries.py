"""The queries of this subpackage, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrove.llm import bpe, chat, exact_dedup, jaccard_tree, langid, lattice_lm, lexical, mixing, secrets, spelling, spotsigs, toxicity, url_rules
from driftgrove.llm.common import crc_remainder, table

#: Target shares of the sources in the mixture.
MIX = {"src0": 0.15, **{f"src{i}": 0.05 for i in range(1, 10)}, "*": 0.40}
MIX_SEED = "mix-1"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Text of both turns of the conversation that op 11 adds.
ODD_TURN = "<|im_end|><|im_start|>assistant ok"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    filters = langid.train(docs.filter(~F.col("held_out")))
    return langid.identify(docs, filters, keep=["doc_id", "held_out"])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id"], decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX, seed=MIX_SEED)


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_held_out(table(spark, sf_dir, "documents"), PIECES)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = toxicity.train(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tree.link_components(table(spark, sf_dir, "documents"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_report(table(spark, sf_dir, "documents"))


def op11_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, i, r, ODD_TURN) for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(odd))).withColumnRenamed("id", "conv_id")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger over three scans: the benchmark's passages, these and all documents, both under older rules."""
    passages = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("path"), "text")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), "text")
    return secrets.ledger_runs(passages, docs)


def spotsigs_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that are near the ones whose id is divisible by 100."""
    docs = table(spark, sf_dir, "documents")
    return spotsigs.search(docs, F.col("doc_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_language_id": op2_language_id,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_source_mix": op5_source_mix,
        "op6_lattice_lm": op6_lattice_lm,
        "op7_url_filter": op7_url_filter,
        "op8_toxicity": op8_toxicity,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_spotsigs": op10_spotsigs,
        "op11_chat_examples": op11_chat_examples,
        "op12_lexical_search": op12_lexical_search,
        "op13_spelling_variants": op13_spelling_variants,
        "secret_ledger": secret_ledger,
        "spotsigs_search": spotsigs_search,
    }


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets_sql() -> str:
    spans, names = [], [r.kind for r in secrets.RULES]
    for i, r in enumerate(secrets.RULES):
        gap = rf"(?s:|.*?[^{r.before}])" if r.before else "(?s:.*?)"
        piece = _quoted(f"({gap})(?:{r.pattern})")
        value = f"regexp_extract_all(t, {piece}, {1 + r.values})" if r.values else "NULL"
        spans.append(
            f"SELECT doc_id, rn, {i} AS ord, g, w, v FROM (SELECT doc_id, rn, regexp_extract_all(t, {piece}, 1) AS g, regexp_extract_all(t, {piece}, 0) AS w, {value}::VARCHAR[] AS v FROM d)"
        )
    least = "CASE ord " + " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(secrets.RULES)) + " END"
    kind = "CASE ord " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(names)) + " END"
    size = "length(coalesce(v[k], substr(w[k], length(g[k]) + 1)))"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({" UNION ALL ".join(spans)}),
    each AS (SELECT doc_id, rn, ord, g, w, v, unnest(range(1, len(w) + 1)) AS k FROM found),
    placed AS (
      SELECT rn, ord, {kind} AS kind, sum(length(w[k])) OVER (PARTITION BY rn, ord ORDER BY k) AS e, length(w[k]) - length(g[k]) AS n, {size} AS size FROM each),
    s AS (SELECT rn, ord, kind, (e - n)::BIGINT AS b, e::BIGINT AS e FROM placed WHERE size >= {least}),
    a AS (
      SELECT rn, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) AS spans,
        string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (WHERE ord < 3) AS base,
        count(*) FILTER (WHERE ord = 0) AS n0, count(*) FILTER (WHERE ord = 1) AS n1, count(*) FILTER (WHERE ord = 2) AS n2
      FROM s GROUP BY rn)
    SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (rn)"""


EXACT_SQL = r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS c FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY c) AS group_size,
      doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, sha256(c) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY c ORDER BY n DESC, doc_id NULLS LAST)"""


def mix_sql() -> str:
    own = [k for k in MIX if k != mixing.OTHER]
    listed = ", ".join(map(_quoted, own))
    weights = ", ".join(f"({_quoted(k)}, {w})" for k, w in MIX.items())
    return f"""
    WITH d AS (SELECT *, CASE WHEN source IN ({listed}) THEN source ELSE '*' END AS c FROM documents),
    n AS (SELECT c, count(*) AS n FROM d GROUP BY c),
    w AS (SELECT c, n, weight FROM n JOIN (VALUES {weights}) AS v(c, weight) USING (c)),
    r AS (SELECT c, weight / (SELECT sum(weight) FROM w) * (SELECT sum(n) FROM n) / n AS rate FROM w),
    t AS (SELECT c, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 60)::BIGINT)) AS k FROM r),
    x AS (SELECT c, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY c ORDER BY k) AS p FROM t),
    u AS (SELECT d.*, ('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496 AS u FROM d),
    m AS (SELECT u.*, rate, (SELECT count(*) FROM x WHERE x.c = u.c AND x.p <= u.u)::INTEGER AS n_copies FROM u JOIN r USING (c)),
    e AS (SELECT m.*, unnest(range(0, n_copies))::INTEGER AS copy_no FROM m)
    SELECT doc_id, text, lang, source, n_chars, rate, n_copies, copy_no,
      md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no) AS shuffle_key FROM e"""


def url_sql() -> str:
    lower = f"translate(coalesce(url, ''), '{url_rules.UPPER}', '{url_rules.LOWER}')"
    host, path = (f"regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', {i})" for i in (1, 2))
    ordered = sorted(url_rules.HOST_RULES, key=lambda r: (-len(r.name), r.name))
    when = lambda what: " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{what(r)}'" for r in ordered)
    hits = " ".join(f"WHEN regexp_matches(u, {_quoted(p)}) THEN {_quoted(p)}" for p in url_rules.PATTERN_RULES)
    return f"""
    WITH p AS (SELECT page_id, {lower} AS u, translate({host}, '{url_rules.UPPER}', '{url_rules.LOWER}') AS host, {path} AS path FROM pages),
    q AS (SELECT *, CASE {hits} END AS pattern FROM p)
    SELECT page_id, host, path, CASE {when(lambda r: r.name)} END AS rule,
      CASE {when(lambda r: r.verdict)} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM q"""


def spotsigs_sql(last: str = "") -> str:
    anchors = ", ".join(map(_quoted, spotsigs.ANCHORS))
    near = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / greatest(len({a}) + len({b}) - len(list_intersect({a}, {b})), 1)::DOUBLE END"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
    x AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    e AS (SELECT *, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) AS edited FROM x),
    texts AS (SELECT doc_id, 0 AS kind, t FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
    bare AS (SELECT *, trim(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS words FROM texts),
    w AS (SELECT doc_id, kind, unnest(string_split(words, ' ')) AS w, unnest(range(len(string_split(words, ' ')))) AS pos FROM bare WHERE words <> ''),
    m AS (SELECT *, w IN ({anchors}) AS anchor, count(*) FILTER (WHERE w NOT IN ({anchors})) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS c FROM w),
    s AS (
      SELECT a.doc_id, a.kind, substr(md5(a.w || ' ' || b.w || ' ' || f.w), 1, 16) AS sig FROM m a
      JOIN m b ON a.doc_id = b.doc_id AND a.kind = b.kind AND NOT b.anchor AND b.c = a.c + 1
      JOIN m f ON a.doc_id = f.doc_id AND a.kind = f.kind AND NOT f.anchor AND f.c = a.c + 2 WHERE a.anchor),
    g AS (SELECT doc_id, kind, list(DISTINCT sig ORDER BY sig) AS sigs FROM s GROUP BY doc_id, kind),
    f AS (
      SELECT bare.doc_id, bare.kind, CASE WHEN t = '' THEN []::VARCHAR[] WHEN sigs IS NOT NULL THEN sigs
        ELSE [substr(md5(CASE WHEN words <> '' THEN words || ' ' ELSE t END), 1, 16)] END AS sigs FROM bare LEFT JOIN g USING (doc_id, kind))
    {last or f"""SELECT e.doc_id, e.n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(o.sigs, '') AS fingerprint, array_to_string(h.sigs, '') AS edited_fingerprint,
      {near("o.sigs", "h.sigs")} AS near_edited, {near("o.sigs", "z.sigs")} AS near_next, len(o.sigs)::BIGINT AS n_signatures
    FROM e JOIN f o ON o.doc_id = e.doc_id AND o.kind = 0 JOIN f h ON h.doc_id = e.doc_id AND h.kind = 1 JOIN f z ON z.doc_id = e.next_id AND z.kind = 0"""}"""


#: Every class of fingerprints against every class of a chosen document.
SEARCH_SQL = """, c AS (SELECT sigs, min(doc_id) AS id, count(*) AS members, count(*) FILTER (WHERE doc_id % 100 = 0) AS wanted FROM f WHERE kind = 0 AND len(sigs) > 0 GROUP BY sigs),
    p AS (SELECT q.id AS query_id, q.wanted AS n_queries, m.id AS match_id, m.members, len(list_intersect(q.sigs, m.sigs)) AS common, len(q.sigs) + len(m.sigs) AS total FROM c q, c m WHERE q.wanted > 0)
    SELECT query_id, n_queries, match_id, members, common / (total - common)::DOUBLE AS near FROM p WHERE common / (total - common) >= 0.8"""


def ledger_sql() -> str:
    """Blobs and findings of the runs of ``secret_ledger``: a blob has findings if one of the rules in force has a long enough match."""
    hit = lambda kinds: " OR ".join(
        f"len(list_filter(regexp_extract_all(t, {_quoted(r.pattern)}, {r.values}), lambda x: length(x) >= {r.least})) > 0"
        for r in secrets.RULES
        if r.kind in kinds
    )
    every = tuple(r.kind for r in secrets.RULES)
    return f"""
    WITH b AS (SELECT DISTINCT coalesce(text, '') AS t FROM benchmark), d AS (SELECT DISTINCT coalesce(text, '') AS t FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)),
    n AS (SELECT (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM d) AS nd)
    SELECT 1 AS run, '{secrets.RULE_VERSION}' AS rule_version, nb AS blobs, nb AS scanned, 0::BIGINT AS skipped, (SELECT count(*) FROM b WHERE {hit(every)}) AS with_findings FROM n
    UNION ALL SELECT 2, '{secrets.RULE_VERSION}', nd, nd - nb, nb, (SELECT count(*) FROM d WHERE {hit(every)}) FROM n
    UNION ALL SELECT 3, '1', nd, nd, 0, (SELECT count(*) FROM d WHERE {hit(secrets.BASE)}) FROM n"""


def chat_sql() -> str:
    size = lambda c: rf"length({c}) + len(regexp_extract_all({c}, '<\\*\|'))"
    return rf"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, i, r, {_quoted(ODD_TURN)} FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
    s AS (SELECT *, role = 'assistant' AS own, 13 + {size("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")} AS head, {size("text")} AS body FROM t),
    p AS (SELECT *, sum(head + body + 11) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS ends FROM s)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE own), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE own), '')) AS loss_sha256,
      sum(head + body + 11)::BIGINT AS formatted_chars, count(*) FILTER (WHERE own) AS n_examples, coalesce(sum(ends - 11) FILTER (WHERE own), 0)::BIGINT AS expanded_chars
    FROM p GROUP BY conv_id"""


#: Word weights in doubles, everything else in integers.
SEARCH_TERMS_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    q AS (SELECT row_number() OVER () AS qn, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
    n AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
    tf AS (SELECT rn, term, count(*) AS tf FROM (SELECT rn, unnest(terms) AS term FROM d) GROUP BY rn, term),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(n.n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, n GROUP BY term),
    m AS (SELECT rn, doc_id, 10 + (90 * len(terms) * n.n) // n.l AS m FROM d, n WHERE len(terms) > 0),
    s AS (
      SELECT qn, item_id, doc_id, rn, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM (SELECT qn, item_id, unnest(terms) AS term FROM q) JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rn) GROUP BY qn, item_id, doc_id, rn),
    r AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


def spelling_sql() -> str:
    """Near words by strings without one code point; the crc32 takes four bits at a time, low ones first."""
    steps = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        steps.append(c)
    digits = "list_transform(range(length(hx)), lambda k: (instr('0123456789ABCDEF', substr(hx, xor(k, 1) + 1, 1)) - 1)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda a, b: xor(a >> 4, [{', '.join(f'{x}::BIGINT' for x in steps)}][(xor(a, b) & 15) + 1])), 4294967295)"
    return rf"""
    WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
    c AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM r GROUP BY doc_id, run),
    h AS (SELECT run, k, {crc} AS h FROM c),
    w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
    v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
    x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
    p AS (
      SELECT DISTINCT x.word AS a, v.word AS b FROM x JOIN v ON x.less = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.less = v.word
      UNION SELECT x.word, y.word FROM x JOIN x y ON x.less = y.less AND x.i = y.i AND x.word <> y.word),
    f AS (
      SELECT v.word, v.n, count(o.word) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS best, max(o.n) AS best_n
      FROM v LEFT JOIN p ON p.a = v.word LEFT JOIN v o ON o.word = p.b GROUP BY v.word, v.n),
    g AS (SELECT word, n, n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM f),
    t AS (SELECT word, form AS root FROM g WHERE form IS NOT NULL UNION ALL SELECT t.word, g.form FROM t JOIN g ON t.root = g.word WHERE g.form IS NOT NULL),
    e AS (SELECT t.word, t.root FROM t JOIN g ON t.root = g.word WHERE g.form IS NULL)
    SELECT g.word, form, coalesce(root, g.word) AS root, n, n_near, form_n FROM g LEFT JOIN e ON e.word = g.word"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secrets_sql(),
        "op3_exact_dedup": EXACT_SQL,
        "op5_source_mix": mix_sql(),
        "op7_url_filter": url_sql(),
        "op10_spotsigs": spotsigs_sql(),
        "op11_chat_examples": chat_sql(),
        "op12_lexical_search": SEARCH_TERMS_SQL,
        "op13_spelling_variants": spelling_sql(),
        "secret_ledger": ledger_sql(),
        "spotsigs_search": spotsigs_sql(SEARCH_SQL.lstrip()),
    }
