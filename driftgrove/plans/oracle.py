"""DuckDB SQL for the registered queries that SQL can express, written independently of the operators."""

from __future__ import annotations

from driftgrove.functions.text import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
ALPHA = BETA = 0.5

#: src: sources in 8 batches; post: token occurrences; dt: distinct tokens of a source; base and last: of the first seven batches, of the eighth.
_SRC = f"""
src AS (
  SELECT doc_id AS source_index, 'doc_' || doc_id AS source_id, lang, source AS origin, text, ntile(8) OVER (ORDER BY doc_id) - 1 AS b,
    list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})) AS tokens
  FROM documents),
post AS (SELECT source_index, source_id, b, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM src),
dt AS (SELECT DISTINCT source_index AS source, b, token FROM post),
base AS (SELECT source, token FROM dt WHERE b < 7),
last AS (SELECT source, token FROM dt WHERE b = 7)"""
_FIRST = """,
seen AS (SELECT token, min(source_index * 16777216 + pos) AS fst, count(DISTINCT source_index) AS df FROM post GROUP BY token)"""
#: The fixed tree: places 1 to 8 in four nodes, a refuge, and places 9 to 12 in two nodes under node 1.
_TREE = """,
bseen AS (SELECT token, min(source_index * 16777216 + pos) AS fst, count(DISTINCT source_index) AS df FROM post WHERE b < 7 GROUP BY token),
vocab AS (SELECT token, df, row_number() OVER (ORDER BY fst) AS word_id FROM bseen),
ranks AS (SELECT * FROM (SELECT token, fst, df, row_number() OVER (ORDER BY df DESC, fst) AS place FROM bseen) JOIN vocab USING (token, df) WHERE place <= 12),
nw AS (SELECT token, word_id, place, CASE WHEN place <= 8 THEN (place + 1) // 2 ELSE 6 + (place - 9) // 2 END AS node_id FROM ranks),
held AS (SELECT node_id, token, source FROM base JOIN nw USING (token)),
ws AS (SELECT * FROM held WHERE node_id <= 4 OR source IN (SELECT source FROM held WHERE node_id = 1)),
ns AS (
  SELECT DISTINCT node_id, source FROM ws
  UNION ALL SELECT 5, source_index FROM src WHERE b < 7 AND source_index NOT IN (SELECT source FROM held WHERE node_id <= 4)),
nodes AS (SELECT * FROM (VALUES (1, 1, 0, false), (2, 1, 1, false), (3, 1, 2, false), (4, 1, 3, false), (5, 1, 4, true), (6, 2, 0, false), (7, 2, 1, false)) AS t(node_id, hkt_id, ord, refuge)),
hkts AS (SELECT * FROM (VALUES (1, 0), (2, 1)) AS t(hkt_id, parent_node_id)),
ex AS (SELECT 1 AS hkt_id, token FROM ranks WHERE place > 1 UNION ALL SELECT 2, token FROM ranks WHERE place > 9)"""
#: The last batch at the root.
_LEVEL = f""",
batch AS (SELECT source_index AS source FROM src WHERE b = 7),
w1 AS (SELECT * FROM nw WHERE node_id <= 4),
hit AS (SELECT DISTINCT node_id, source FROM last JOIN w1 USING (token)),
routed AS (SELECT * FROM hit UNION ALL SELECT 5, source FROM batch WHERE source NOT IN (SELECT source FROM hit)),
df1 AS (SELECT token, count(*) AS df1 FROM last GROUP BY token),
df0 AS (SELECT token, count(*) AS df0 FROM base GROUP BY token),
s0 AS (SELECT node_id, token, source FROM ws WHERE node_id <= 4),
s1 AS (SELECT node_id, token, source FROM routed JOIN last USING (source)),
n0 AS (SELECT node_id, token, count(*) AS n0 FROM s0 GROUP BY ALL),
n1 AS (SELECT node_id, token, count(*) AS n1 FROM s1 GROUP BY ALL),
own AS (SELECT w1.node_id, w1.token, w1.word_id, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1 FROM w1 LEFT JOIN n0 USING (node_id, token) LEFT JOIN n1 USING (node_id, token)),
totals AS (SELECT token, coalesce(df0, 0) + coalesce(df1, 0) AS total, df1 FROM df0 FULL JOIN df1 USING (token)),
lead AS (SELECT n0 FROM own WHERE node_id = 1 ORDER BY word_id LIMIT 1),
adm AS (SELECT token FROM totals WHERE df1 IS NOT NULL AND token NOT IN (SELECT token FROM w1) AND total / greatest((SELECT n0 FROM lead), 1) >= {ALPHA}),
e1 AS (SELECT token, coalesce(total, 0) AS total FROM (SELECT token FROM ex WHERE hkt_id = 1 UNION SELECT token FROM adm) LEFT JOIN totals USING (token)),
most AS (SELECT greatest((SELECT max(n0 + n1) FROM own), (SELECT max(total) FROM e1), 1) AS m),
e AS (SELECT token, total FROM e1 WHERE total / (SELECT m FROM most) >= {ALPHA}),
tog AS (SELECT DISTINCT node_id, token, source, word_id FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1) JOIN w1 USING (node_id, token)),
best AS (SELECT node_id, token FROM (SELECT node_id, token, row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, word_id) AS r FROM tog GROUP BY node_id, token, word_id) WHERE r = 1),
prom AS (SELECT node_id, source FROM tog SEMI JOIN best USING (node_id, token)),
psize AS (SELECT node_id, count(*) AS size FROM prom GROUP BY ALL),
asg AS (
  SELECT s1.node_id, s1.token FROM s1 SEMI JOIN e USING (token) LEFT JOIN prom p ON p.node_id = s1.node_id AND p.source = s1.source JOIN psize z ON z.node_id = s1.node_id
  WHERE s1.node_id <= 4 GROUP BY s1.node_id, s1.token HAVING count(p.source) / greatest(any_value(size), 1) >= {BETA})"""
_CHANGE = f""",
per AS (
  SELECT greatest((SELECT sum(n0) FROM own), 1) AS all0, greatest((SELECT sum(n0 + n1) FROM own) + coalesce((SELECT sum(total) FROM e), 0), 1) AS all1,
    greatest((SELECT n0 FROM lead), 1) AS p0, greatest((SELECT max(n0 + n1) FROM own), coalesce((SELECT max(total) FROM e), 0), 1) AS p1),
inw AS (SELECT node_id, token FROM w1 UNION SELECT node_id, token FROM asg),
leadw AS (SELECT node_id, arg_min(token, word_id) AS token FROM w1 GROUP BY node_id),
lsrc AS (SELECT node_id, source FROM s0 SEMI JOIN leadw USING (node_id, token)),
inside AS (SELECT node_id, source FROM ns WHERE node_id <= 4 UNION SELECT node_id, source FROM routed WHERE node_id <= 4),
mix AS (SELECT node_id, token, source, min(fresh) AS fresh FROM (SELECT *, 0 AS fresh FROM s0 UNION ALL SELECT *, 1 FROM s1) GROUP BY ALL),
byw AS (
  SELECT x.node_id, x.token, count(*) FILTER (WHERE fresh = 0) AS before, count(*) AS after, count(i.source) AS c1, count(l.source) FILTER (WHERE fresh = 0) AS c0
  FROM mix x LEFT JOIN inside i ON i.node_id = x.node_id AND i.source = x.source LEFT JOIN lsrc l ON l.node_id = x.node_id AND l.source = x.source GROUP BY ALL),
z0 AS (SELECT node_id, count(*) AS z0 FROM lsrc GROUP BY ALL), z1 AS (SELECT node_id, count(*) AS z1 FROM inside GROUP BY ALL),
rows1 AS (
  SELECT node_id, token, coalesce(before, 0) AS before, coalesce(after, 0) - coalesce(before, 0) AS new, coalesce(after, 0) AS after,
    coalesce(c0, 0) / greatest(coalesce(z0, 0), 1) AS eligibility0, coalesce(c1, 0) / greatest(coalesce(z1, 0), 1) AS eligibility1
  FROM inw LEFT JOIN byw USING (node_id, token) LEFT JOIN z0 USING (node_id) LEFT JOIN z1 USING (node_id)),
one AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY node_id DESC) AS r FROM rows1) WHERE r = 1),
every AS (
  SELECT * FROM one UNION ALL
  SELECT 0, token, 0, coalesce(df1, 0), total, 0.0, 0.0 FROM e LEFT JOIN df1 USING (token) WHERE token NOT IN (SELECT token FROM inw)),
chg AS (
  SELECT token, node_id, before, new, after, before / p0 AS strength0, after / p1 AS strength1, eligibility0::DOUBLE AS eligibility0, eligibility1::DOUBLE AS eligibility1,
    before / all0 AS importance0, after / all1 AS importance1 FROM every, per),
err AS (
  SELECT count(*) AS n, coalesce(avg(strength1), 0) AS alpha_value, coalesce(avg(eligibility1), 0) AS beta_value, coalesce(sum(importance1), 0) AS retained,
    coalesce(sum(greatest({ALPHA} - strength1, 0)) / count(*), 0) AS alpha1, coalesce(sum(abs(strength1 - strength0)) FILTER (WHERE strength1 < {ALPHA}), 0) / greatest(count(*), 1) AS alpha2,
    sqrt(coalesce(sum((strength0 - strength1) ** 2), 0)) AS alpha3,
    coalesce(sum(greatest({BETA} - eligibility1, 0)) / count(*), 0) AS beta1, coalesce(sum(abs(eligibility1 - eligibility0)) FILTER (WHERE eligibility1 < {BETA}), 0) / greatest(count(*), 1) AS beta2,
    sqrt(coalesce(sum((eligibility0 - eligibility1) ** 2), 0)) AS beta3,
    1 - coalesce(sum(importance1), 0) AS wi1, sqrt(coalesce(sum((importance0 - importance1) ** 2), 0)) AS wi2
  FROM chg WHERE node_id <> 0)"""
_SIZES = """,
words1 AS (SELECT token, token IN (SELECT token FROM vocab) AS known FROM df1),
sizes AS (
  SELECT 1 AS hkt_id, (SELECT count(*) FROM batch) AS scoped_sources, (SELECT count(DISTINCT node_id) FROM routed) AS matched_nodes,
    count(*) FILTER (WHERE known) AS known_words, count(*) FILTER (WHERE NOT known) AS new_words FROM words1)"""
_NAMES = """,
names AS (SELECT node_id, list(token ORDER BY word_id) AS names FROM nw GROUP BY node_id UNION ALL SELECT 5, ['<REFUGE>']),
label AS (SELECT node_id, array_to_string(names[1:4], ' ') AS label, names FROM names),
cnt AS (SELECT node_id, count(*) AS source_count FROM ns GROUP BY node_id),
cat AS (SELECT arg_min(token, word_id) AS category FROM ranks WHERE place > 1),
cata AS (
  SELECT source_id, coalesce(nullif(substr(regexp_replace(coalesce(text, ''), '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g'), 1, 120), ''), nullif(array_to_string(tokens[1:16], ' '), ''), source_id) AS title, source_index FROM src),
asn AS (SELECT source_id, (SELECT category FROM cat) AS hkt, node_id::INTEGER AS node_id, label AS node_label, title, '' AS url FROM ns JOIN label USING (node_id) JOIN cata ON cata.source_index = ns.source)"""


def _round(c: str) -> str:
    return f"(floor(abs({c}) * 10000 + 0.5) / 10000) * sign({c})"


def statements() -> dict[str, str]:
    src = f"WITH {_SRC.lstrip()}"
    first, tree = src + _FIRST, src + _TREE
    level, change = tree + _LEVEL, tree + _LEVEL + _CHANGE
    sizes = level + _SIZES
    names = tree + _NAMES
    older = f"""{level},
      seen1 AS (SELECT token, df1 FROM df1 SEMI JOIN vocab USING (token)),
      prom1 AS (SELECT coalesce(max(df1), 0) AS p FROM seen1 WHERE token IN (SELECT token FROM e UNION SELECT token FROM w1)),
      str1 AS (SELECT token, df1, CASE WHEN p > 0 THEN coalesce(df1, 0) / p ELSE 0 END AS s FROM e LEFT JOIN seen1 USING (token), prom1),
      nv AS (SELECT node_id, count(*) FILTER (WHERE token NOT IN (SELECT token FROM vocab)) / count(*) AS share FROM n1 GROUP BY node_id),
      zz AS (SELECT node_id, count(*) AS size FROM routed GROUP BY node_id), ww AS (SELECT node_id, token FROM w1 UNION ALL SELECT 5, NULL),
      pb AS (SELECT avg(greatest({BETA} - coalesce(n1 / size, 0), 0)) AS beta_error FROM ww LEFT JOIN n1 USING (node_id, token) LEFT JOIN zz USING (node_id)),
      old AS (
        SELECT count(*) AS expected_words, count(df1) AS retained_words, (SELECT sum(df1) FROM df1) AS total_df, coalesce(sum(df1), 0) / (SELECT sum(df1) FROM df1) AS mass, (SELECT p FROM prom1) AS prominent_df,
          count(*) FILTER (WHERE s < {ALPHA}) AS alpha_violations, avg(greatest({ALPHA} - s, 0)) AS alpha_error, (SELECT avg(share) FROM nv) AS beta_value, (SELECT beta_error FROM pb) AS beta_error FROM str1)"""
    hashed = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(octet_length(source_id::BLOB)), lambda i: ('0x' || substr(hex(source_id::BLOB), 2 * i + 1, 2))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    batch_stats = f"""{tree},
      lw AS (SELECT token, count(*) AS df FROM last GROUP BY token)
      SELECT count(*)::BIGINT AS unique_words, count(*) FILTER (WHERE token IN (SELECT token FROM vocab))::BIGINT AS known_words, count(*) FILTER (WHERE token NOT IN (SELECT token FROM vocab))::BIGINT AS new_words,
        coalesce(max(df), 0)::BIGINT AS max_df, (SELECT count(*) FROM src WHERE b = 7)::BIGINT AS sources FROM lw"""
    out = {
        "scan_sources": f"{src} SELECT 0::BIGINT AS batch_index, source_index, source_id, len(tokens)::INTEGER AS n_tokens, '{{\"lang\":\"' || lang || '\",\"source\":\"' || origin || '\"}}' AS metadata FROM src",
        "csv_ingest": f"""
          WITH r AS (SELECT doc_id + 1 AS n, trim(regexp_replace(concat_ws(' ', coalesce(text, ''), coalesce(lang, ''), coalesce(source, '')), '\\s+', ' ', 'g')) AS text, source FROM documents),
          t AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})) AS w FROM r)
          SELECT n AS source_index, format('row_{{:06d}}', n) AS source_id, array_to_string(w, ' ') AS tokens, text, '{{"url":"http://x/' || source || '"}}' AS metadata FROM t WHERE text <> '' AND len(w) >= 3""",
        "source_catalog": f"{names} SELECT source_id, title, '' AS url FROM cata",
        "source_ids": f"{src}, h AS (SELECT source_id, {hashed} AS h FROM src) SELECT source_id, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS internal_id FROM h",
        "chunk_batches": f"{src} SELECT b::BIGINT AS batch_index, count(*)::BIGINT AS sources, min(source_index) AS first, max(source_index) AS last FROM src GROUP BY b",
        "source_registry": f"{src} SELECT source_id, (CASE WHEN source_index % 10 = 0 THEN 8 ELSE b END)::BIGINT AS last_batch, (CASE WHEN source_index % 10 = 0 THEN 2 ELSE 1 END)::BIGINT AS batches FROM src",
        "stream_registry": f"{src}, sent AS (SELECT source_id, b FROM src UNION ALL SELECT source_id, 8 FROM src WHERE source_index % 10 = 0) SELECT source_id, max(b)::BIGINT AS last_batch, count(*)::BIGINT AS batches FROM sent WHERE b > 5 GROUP BY source_id",
        "postings_rows": f"{src} SELECT source_index, source_id, pos::BIGINT AS pos, token FROM post",
        "doc_tokens": f"{src} SELECT source AS source_index, token FROM dt",
        "word_df": f"{first} SELECT token, df::BIGINT AS df FROM seen",
        "vocabulary": f"{first} SELECT (row_number() OVER (ORDER BY fst))::INTEGER AS word_id, token, df::BIGINT AS df FROM seen",
        "ranked_words": f"{first} SELECT token, df::BIGINT AS df, (fst // 16777216)::BIGINT AS first, nth, row_number() OVER (ORDER BY df DESC, fst)::BIGINT AS place FROM seen JOIN (SELECT token, source_index * 16777216 + min(pos) AS fst, (row_number() OVER (PARTITION BY source_index ORDER BY min(pos)) - 1)::INTEGER AS nth FROM post GROUP BY token, source_index) USING (token, fst)",
        "expected_words": f"{first} SELECT token, df::BIGINT AS df FROM seen WHERE df / (SELECT max(df) FROM seen) >= 0.5",
        "expected_prefix": f"""{src},
          f AS (SELECT lang, token, source_index * 16777216 + min(pos) AS fst FROM post JOIN src USING (source_index) GROUP BY lang, token, source_index),
          d AS (SELECT *, count(*) OVER (PARTITION BY lang, token) AS df FROM f),
          r AS (SELECT *, df / first_value(df) OVER (PARTITION BY lang ORDER BY fst) AS ratio FROM d),
          k AS (SELECT *, count(*) FILTER (WHERE ratio < 0.1) OVER (PARTITION BY lang ORDER BY fst) AS low FROM r)
          SELECT DISTINCT lang AS scope, token FROM k WHERE low = 0""",
        "seed_word": f"{first} SELECT token, df::BIGINT AS df FROM seen ORDER BY df DESC, fst LIMIT 1",
        "scope_filter": f"{src} SELECT token, count(*)::BIGINT AS df FROM dt WHERE source IN (SELECT doc_id FROM labels) GROUP BY token",
        "branch_scope": f"""{first}, seed AS (SELECT token FROM seen ORDER BY df DESC, fst LIMIT 1)
          SELECT token, count(*)::BIGINT AS df FROM dt WHERE source IN (SELECT source FROM dt SEMI JOIN seed USING (token)) AND token NOT IN (SELECT token FROM seed) GROUP BY token""",
        "known_new_words": f"{tree} SELECT token, count(*)::BIGINT AS df, token IN (SELECT token FROM vocab) AS known FROM last GROUP BY token",
        "batch_word_stats": batch_stats,
        "batch_trigger_metrics": f"""WITH s AS ({batch_stats}),
          m AS (SELECT known_words / unique_words AS alpha_estimate, new_words / unique_words AS beta_estimate, max_df / sources AS word_importance_error FROM s),
          x AS (SELECT *, abs(alpha_estimate - {ALPHA}) AS alpha_error, abs(beta_estimate - {BETA}) AS beta_error FROM m)
          SELECT alpha_estimate, beta_estimate, alpha_error, beta_error, word_importance_error,
            concat_ws(',', CASE WHEN alpha_error > 0.1 THEN 'alpha_error' END, CASE WHEN beta_error > 0.1 THEN 'beta_error' END, CASE WHEN word_importance_error > 0.1 THEN 'word_importance_error' END) AS reasons,
            alpha_error > 0.1 OR beta_error > 0.1 OR word_importance_error > 0.1 AS triggered FROM x""",
        "containment": f"""{first}, r AS (SELECT source, token FROM dt SEMI JOIN (SELECT token FROM seen WHERE df / (SELECT max(df) FROM seen) >= 0.5) USING (token)), z AS (SELECT token, count(*) AS n FROM r GROUP BY token)
          SELECT a.token, b.token AS other, count(*) / any_value(z.n) AS share FROM r a JOIN r b USING (source) JOIN z ON z.token = a.token GROUP BY a.token, b.token""",
        "refuge_sources": f"{tree} SELECT source FROM ns WHERE node_id = 5",
        "top_words": f"""{first}, seed AS (SELECT token FROM seen ORDER BY df DESC, fst LIMIT 1),
          below AS (SELECT token, count(DISTINCT source_index) AS df, min(source_index * 16777216 + pos) AS fst FROM post WHERE source_index IN (SELECT source FROM dt SEMI JOIN seed USING (token)) AND token NOT IN (SELECT token FROM seed) GROUP BY token)
          SELECT token FROM (SELECT token FROM below ORDER BY df DESC, fst LIMIT 9) UNION ALL SELECT token FROM seed""",
        "route_batch": f"{level} SELECT 1 AS hkt_id, node_id::INTEGER AS node_id, source FROM routed",
        "scope_df": f"{level} SELECT 1 AS hkt_id, token, df1::BIGINT AS df1 FROM df1",
        "node_df": f"{level} SELECT 1 AS hkt_id, node_id::INTEGER AS node_id, token, n1::BIGINT AS df1 FROM n1",
        "state0_df": f"{level} SELECT 1 AS hkt_id, token, df0::BIGINT AS df0 FROM df0",
        "state0_node_postings": f"{level} SELECT 1 AS hkt_id, node_id::INTEGER AS node_id, token, source FROM s0",
        "update_stage": f"{level} SELECT 1 AS hkt_id, 0 AS node_id, token FROM e UNION ALL SELECT 1, node_id::INTEGER, token FROM asg",
        "word_change": f"""{change} SELECT 1 AS hkt_id, token, node_id::INTEGER AS node_id, before::BIGINT AS before, new::BIGINT AS new, after::BIGINT AS after,
          round(strength0, 9) AS strength0, round(strength1, 9) AS strength1, round(eligibility0, 9) AS eligibility0, round(eligibility1, 9) AS eligibility1, round(importance0, 9) AS importance0, round(importance1, 9) AS importance1,
          round({ALPHA} - strength0, 9) AS alpha_gap0, round({ALPHA} - strength1, 9) AS alpha_gap1, CASE WHEN node_id = 0 THEN 0.0 ELSE round({BETA} - eligibility0, 9) END AS beta_gap0,
          CASE WHEN node_id = 0 THEN 0.0 ELSE round({BETA} - eligibility1, 9) END AS beta_gap1, round(greatest({ALPHA} - strength1, 0), 9) AS alpha_error, CASE WHEN node_id = 0 THEN 0.0 ELSE round(greatest({BETA} - eligibility1, 0), 9) END AS beta_error FROM chg""",
        "paper_metrics": f"""{change} SELECT 1 AS hkt_id, n::INTEGER AS n, round(alpha_value, 9) AS alpha_value, round(beta_value, 9) AS beta_value, round(retained, 9) AS retained,
          {", ".join(f"{_round(c)} AS {c}" for c in ("alpha1", "alpha2", "alpha3", "beta1", "beta2", "beta3", "wi1", "wi2"))} FROM err""",
        "paper_trigger": f"""{change}, d AS (SELECT {_round("alpha1")} AS a, {_round("beta1")} AS b, {_round("wi1")} AS w, (SELECT count(*) FROM batch) AS k FROM err),
          r AS (SELECT *, concat_ws(',', CASE WHEN w > 0.3 THEN 'word_importance' END, CASE WHEN a > 0.1 THEN 'alpha' END, CASE WHEN b > 0.13 THEN 'beta' END, CASE WHEN k <= 1 AND (w > 0.3 OR a > 0.1 OR b > 0.13) THEN 'tiny' END) AS reasons FROM d)
          SELECT 1 AS hkt_id, k::BIGINT AS scoped_sources, a AS alpha_error, b AS beta_error, w AS wi_error, 0.1::DOUBLE AS alpha_threshold, 0.13::DOUBLE AS beta_threshold, 0.3::DOUBLE AS wi_threshold, reasons, reasons <> '' AS triggered FROM r""",
        "placeholder_trigger": f"""{sizes}, d AS (SELECT scoped_sources AS k, known_words / (known_words + new_words) AS a, new_words / (known_words + new_words) AS w FROM sizes),
          r AS (SELECT *, concat_ws(',', CASE WHEN w > 0.1 THEN 'word_importance' END, CASE WHEN k <= 1 AND w > 0.1 THEN 'tiny' END) AS reasons FROM d)
          SELECT 1 AS hkt_id, k::BIGINT AS scoped_sources, abs(a - {ALPHA}) AS alpha_error, abs(w - {BETA}) AS beta_error, w AS wi_error, 0.1::DOUBLE AS alpha_threshold, 0.1::DOUBLE AS beta_threshold, 0.1::DOUBLE AS wi_threshold, reasons, reasons <> '' AS triggered FROM r""",
        "scope_sizes": f"{sizes} SELECT hkt_id, scoped_sources::BIGINT AS scoped_sources, matched_nodes::BIGINT AS matched_nodes, known_words::BIGINT AS known_words, new_words::BIGINT AS new_words FROM sizes",
        "rebuild_report": f"{sizes} SELECT hkt_id, scoped_sources::BIGINT AS scoped_sources, (known_words + new_words)::BIGINT AS words, known_words::BIGINT AS known_words, new_words::BIGINT AS new_words FROM sizes",
        "node_beta": f"""{level}, v AS (SELECT node_id, count(*) FILTER (WHERE token IN (SELECT token FROM vocab)) AS known_words, count(*) FILTER (WHERE token NOT IN (SELECT token FROM vocab)) AS new_words FROM n1 GROUP BY node_id)
          SELECT 1 AS hkt_id, node_id, CASE WHEN refuge THEN 1 ELSE 2 END::BIGINT AS state0_words, coalesce(known_words, 0)::BIGINT AS known_words, coalesce(new_words, 0)::BIGINT AS new_words,
            round(coalesce(new_words / nullif(known_words + new_words, 0), 0), 9) AS share FROM nodes LEFT JOIN v USING (node_id) WHERE hkt_id = 1""",
        "paper_inputs": f"""{change}{_SIZES}, own2 AS (SELECT * FROM chg LEFT JOIN df1 USING (token) WHERE node_id <> 0)
          SELECT 1 AS hkt_id, count(*)::BIGINT AS state0_words, any_value(known_words)::BIGINT AS known_words, any_value(new_words)::BIGINT AS new_words, count(df1)::BIGINT AS retained_words, (SELECT sum(df1) FROM df1)::BIGINT AS total_df,
            round(sum(df1) / (SELECT sum(df1) FROM df1), 9) AS mass, round(count(df1) / count(*), 9) AS retained_ratio, round(any_value(known_words / (known_words + new_words)), 9) AS known_ratio,
            round(any_value(new_words / (known_words + new_words)), 9) AS new_ratio, max(after)::BIGINT AS prominent_df, count(*) FILTER (WHERE strength1 < {ALPHA})::BIGINT AS alpha_violations FROM own2, sizes""",
        "expected_inputs": f"{older} SELECT 1 AS hkt_id, expected_words::BIGINT AS expected_words, retained_words::BIGINT AS retained_words, total_df::BIGINT AS total_df, round(mass, 9) AS mass, prominent_df::BIGINT AS prominent_df, alpha_violations::BIGINT AS alpha_violations, round(retained_words / expected_words, 9) AS alpha_value, round(beta_value, 9) AS beta_value, round(alpha_error, 9) AS alpha_error, round(beta_error, 9) AS beta_error, round(1 - mass, 9) AS wi_error FROM old",
        "shadow_reasons": f"""{older} SELECT 1 AS hkt_id, concat_ws(',', CASE WHEN 1 - mass > 0.3 THEN 'word_importance' END, CASE WHEN alpha_error > 0.1 THEN 'alpha' END, CASE WHEN beta_error > 0.13 THEN 'beta' END,
          CASE WHEN (SELECT count(*) FROM batch) <= 1 AND (1 - mass > 0.3 OR alpha_error > 0.1 OR beta_error > 0.13) THEN 'tiny' END) AS shadow_reasons FROM old""",
        "plain_beta": f"""{level}, z AS (SELECT node_id, count(*) AS size FROM routed GROUP BY node_id), ww AS (SELECT node_id, token FROM w1 UNION ALL SELECT 5, NULL)
          SELECT 1 AS hkt_id, round(avg(greatest({BETA} - coalesce(n1 / size, 0), 0)), 9) AS beta_error FROM ww LEFT JOIN n1 USING (node_id, token) LEFT JOIN z USING (node_id)""",
        "merge_state1": f"{level}, folded AS (SELECT node_id, token, source FROM ws UNION SELECT node_id, token, source FROM s1 SEMI JOIN (SELECT node_id, token FROM w1 UNION SELECT node_id, token FROM asg) q USING (node_id, token)) SELECT node_id::INTEGER AS node_id, token, count(*)::BIGINT AS n FROM folded GROUP BY ALL",
        "next_frontier": f"{level} SELECT 2 AS hkt_id, source FROM routed WHERE node_id = 1",
        "window_sources": f"""{tree}, act AS (SELECT source_index AS source FROM src WHERE b >= 5) SELECT node_id::INTEGER AS node_id, count(*)::BIGINT AS n FROM ns SEMI JOIN act USING (source)
          WHERE node_id = 5 OR node_id IN (SELECT node_id FROM ws SEMI JOIN act USING (source)) GROUP BY node_id""",
        "tree_edges": f"{tree} SELECT parent_node_id, hkt_id AS child_hkt_id FROM hkts WHERE parent_node_id <> 0",
        "verbose_nodes": f"""{names}, q AS (SELECT node_id, string_agg('doc_' || source, ',' ORDER BY source) AS sources FROM ns GROUP BY node_id)
          SELECT nodes.node_id, hkt_id, ord, refuge, array_to_string(names, ' ') AS words, sources FROM nodes JOIN names USING (node_id) JOIN q USING (node_id)""",
        "verbose_hkts": f"""{tree} SELECT hkt_id, parent_node_id, (SELECT string_agg(node_id::VARCHAR, ',' ORDER BY ord) FROM nodes n WHERE n.hkt_id = hkts.hkt_id) AS node_ids,
          (SELECT string_agg(token, ' ' ORDER BY word_id) FROM ex JOIN vocab USING (token) WHERE ex.hkt_id = hkts.hkt_id) AS expected_words,
          (SELECT string_agg(token, ' ' ORDER BY word_id) FROM nw JOIN nodes n USING (node_id) WHERE n.hkt_id = hkts.hkt_id) AS words FROM hkts""",
        "tree_view": f"""{names} SELECT 'node:' || node_id AS id, CASE WHEN parent_node_id = 0 THEN '' ELSE 'node:' || parent_node_id END AS parent, label, node_id, hkt_id, (hkt_id - 1)::INTEGER AS depth, source_count::INTEGER AS source_count,
          (SELECT category FROM cat) AS category, label AS topic, label AS title, label AS source, '' AS url, source_count::INTEGER AS value, source_count / (SELECT max(source_count) FROM cnt) AS strength_pct,
          array_to_string(names[1:10], ', ') AS tokens, (SELECT string_agg('doc_' || source, ', ' ORDER BY source) FROM ns x WHERE x.node_id = nodes.node_id) AS source_ids, refuge AS is_refuge_node FROM nodes JOIN hkts USING (hkt_id) JOIN label USING (node_id) JOIN cnt USING (node_id)""",
        "node_paths": f"{names} SELECT nodes.node_id, CASE WHEN hkt_id = 2 THEN (SELECT label FROM label WHERE node_id = 1) || ' ▶ ' ELSE '' END || label AS path FROM nodes JOIN label USING (node_id)",
        "tree_validation": "SELECT 2::BIGINT AS total_hkts, 7::BIGINT AS total_nodes, 7::BIGINT AS rendered_nodes, 0::BIGINT AS skipped_nodes",
        "source_assignments": f"{names} SELECT * FROM asn",
        "hkt_treemap": f"""{names}, one AS (SELECT source_id, hkt, any_value(title) AS title FROM asn GROUP BY ALL)
          SELECT 'hkt:' || hkt AS id, '' AS parent, hkt AS label, count(*)::BIGINT AS value, '' AS url, hkt FROM one GROUP BY hkt
          UNION ALL SELECT 'src:' || hkt || '::' || source_id, 'hkt:' || hkt, substr(title, 1, 120), 1, '', hkt FROM one""",
        "assign_filter": f"{names} SELECT * FROM asn WHERE node_id = 6",
        "source_search": f"{names} SELECT DISTINCT source_id, title FROM asn WHERE regexp_matches(title, '(?i)DOC_1') OR regexp_matches(source_id, '(?i)DOC_1') ORDER BY source_id LIMIT 50",
        "subtree_filter": f"{names} SELECT node_id::INTEGER AS node_id, label FROM label WHERE node_id IN (1, 6, 7)",
        "tree_explorer": f"{names} SELECT node_id::INTEGER AS node_id, label, source_count::INTEGER AS source_count FROM label JOIN cnt USING (node_id) WHERE node_id <= 5 AND source_count >= 2",
        "ancestor_chain": "SELECT unnest([6, 1])::INTEGER AS node_id",
        "doc_lengths": f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})))::BIGINT AS n_tokens FROM conversations",
    }
    viewed = out["tree_view"]
    return out | {"scan_document": out["scan_sources"], "tree_document": viewed, "tree_lines": viewed, "event_dates": EVENT_DATES, "update_notes": _notes(out)}


EVENT_DATES = """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts::DATE END AS date, 'none' AS topic, ts::DATE AS day,
      CASE WHEN event_type = 'error' THEN 1.0 ELSE coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 1.0) END AS value FROM events"""


def _notes(made: dict[str, str]) -> str:
    """Lines on HKT 1 from the figures of other statements."""
    four = lambda c: f"printf('%.4f', {c}::DOUBLE)"
    line = lambda n, text, only="true": f"SELECT 1 AS hkt_id, {n} AS line, {text} AS text FROM f WHERE {only}"
    lines = [
        line(0, "'HKT 1: scoped sources=' || scoped_sources || ', matched nodes=' || matched_nodes || ', known words=' || known_words || ', new words=' || new_words"),
        line(1, "'HKT 1 update: expected words=' || wanted", "wanted > 0"),
        line(2, f"'HKT 1 errors: word_importance=' || {four('wi_error')} || ', alpha=' || {four('alpha_error')} || ', beta=' || {four('beta_error')}"),
        line(3, "'HKT 1 policy: PaperDiagnosticScaffold'"),
        line(4, "'HKT 1 words accepted above: 0'"),
        line(5, f"'HKT 1 figures: words=' || state0_words || ', retained=' || retained_words || ', total_df=' || total_df || ', mass=' || {four('mass')} || ', prominent_df=' || prominent_df || ', below alpha=' || alpha_violations"),
        line(6, "'HKT 1 shadow: would trigger=' || triggered"),
        line(7, "'HKT 1 shadow reasons: ' || reasons", "reasons <> ''"),
        line(8, "'HKT 1 trigger reasons: ' || reasons", "triggered"),
        f"SELECT 1, (9 + node_id)::INTEGER, 'HKT 1 node ' || node_id || ': beta=' || {four('share')} || ' (own words=' || state0_words || ', known=' || known_words || ', new=' || new_words || ')' FROM ({made['node_beta']})",
    ]
    return f"""
    WITH f AS (
      SELECT z.*, i.* EXCLUDE (hkt_id, known_words, new_words), d.wi_error, d.alpha_error, d.beta_error, d.reasons, d.triggered, (SELECT count(*) FROM ({made['update_stage']}) WHERE node_id = 0) AS wanted
      FROM ({made['scope_sizes']}) z JOIN ({made['paper_inputs']}) i USING (hkt_id) JOIN ({made['paper_trigger']}) d USING (hkt_id))
    {" UNION ALL ".join(lines)}"""
