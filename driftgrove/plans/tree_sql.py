"""DuckDB SQL for the queries over trees built from ``pages``: whole trees by a recursive query, and what follows from them.

The fold is a reduction of lists: each frequent word comes as a list of one node, and joins the
node of the accumulated list of whose sources it covers most, or goes to the end of it.
"""

from __future__ import annotations

LEAST_SHARE = SIMILARITY = 0.5
MIN_SOURCES = 20
TOP = 10

#: psrc: pages in 8 batches; pdt: distinct tokens of a page with their first place; pvoc: words of the first seven batches by first appearance.
PAGES = """
psrc AS (
  SELECT page_id AS source, 'page_' || page_id AS source_id, url, ntile(8) OVER (ORDER BY page_id) - 1 AS b,
    list_transform(regexp_extract_all(coalesce(url, ''), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS tokens FROM pages),
ppost AS (SELECT source, b, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM psrc),
pdt AS (SELECT source, b, token, source * 16777216 + min(pos) AS fst FROM ppost GROUP BY source, b, token),
pall AS (SELECT token, (row_number() OVER (ORDER BY min(fst)))::INTEGER AS word FROM pdt GROUP BY token),
pvoc AS (SELECT token, (row_number() OVER (ORDER BY min(fst)))::INTEGER AS word FROM pdt WHERE b < 7 GROUP BY token)"""

_SHARES = "list_transform(acc, lambda n: len(list_intersect(n.sources, x[1].sources)) / len(n.sources))"
_FOLD = f"""list_reduce(list_transform(line, lambda x: [x]), lambda acc, x:
    CASE WHEN list_max({_SHARES}) >= {SIMILARITY}
      THEN list_transform(acc, lambda n, i: CASE WHEN i = list_position({_SHARES}, list_max({_SHARES}))
        THEN {{'words': list_concat(n.words, x[1].words), 'sources': list_distinct(list_concat(n.sources, x[1].sources))}} ELSE n END)
      ELSE list_concat(acc, x) END)"""


def _nodes(scope: str, name: str, arrival: bool = False) -> str:
    """CTEs from postings ``scope`` (t, path, source, word, at): name_e (expected words) and name_n (nodes). ``arrival``: the scopes are in order of arrival."""
    if arrival:
        pick = f"""
{name}_m AS (SELECT t, path, arg_min(df, fst) AS most, arg_min(word, fst) AS seed FROM {name}_d GROUP BY t, path),
{name}_z AS (SELECT t, path, min(fst) AS stop FROM {name}_d JOIN {name}_m USING (t, path) WHERE df / most < {LEAST_SHARE} GROUP BY t, path),
{name}_e AS (SELECT t, path, word, df, fst, srcs, seed FROM {name}_d JOIN {name}_m USING (t, path) LEFT JOIN {name}_z USING (t, path) WHERE stop IS NULL OR fst < stop),"""
    else:
        pick = f"""
{name}_m AS (SELECT t, path, max(df) AS most, arg_min(word, {{'d': -df, 'f': fst}}) AS seed FROM {name}_d GROUP BY t, path),
{name}_e AS (SELECT t, path, word, df, fst, srcs, seed FROM {name}_d JOIN {name}_m USING (t, path) WHERE df / most >= {LEAST_SHARE}),"""
    return f"""{name}_d AS (SELECT t, path, word, count(*) AS df, min("at") AS fst, list(source) AS srcs FROM {scope} GROUP BY t, path, word),{pick}
{name}_l AS (SELECT t, path, list({{'words': [word], 'sources': srcs}} ORDER BY (word <> seed), word) AS line FROM {name}_e GROUP BY t, path),
{name}_f AS (SELECT t, path, {_FOLD} AS nodes FROM {name}_l),
{name}_o AS (SELECT s.t, s.path, list(DISTINCT source) AS missed FROM {scope} s JOIN {name}_f f ON f.t = s.t AND f.path = s.path WHERE NOT list_contains(flatten(list_transform(f.nodes, lambda n: n.sources)), source) GROUP BY s.t, s.path),
{name}_n AS (
  SELECT t, path, unnest(range(len(nodes)))::INTEGER AS ord, false AS refuge, unnest(list_transform(nodes, lambda n: n.words)) AS words, unnest(list_transform(nodes, lambda n: n.sources)) AS sources FROM {name}_f
  UNION ALL SELECT t, path, len(nodes)::INTEGER, true, []::INTEGER[], missed FROM {name}_o JOIN {name}_f USING (t, path))"""


def _below(scope: str, nodes: str) -> str:
    return f"""SELECT s.t, list_append(s.path, n.ord) AS path, s.source, s.word, s."at" FROM {scope} s JOIN {nodes} n ON n.t = s.t AND n.path = s.path
      WHERE len(n.sources) > {MIN_SOURCES} AND list_contains(n.sources, s.source) AND NOT list_contains(n.words, s.word)"""


def tree(init: str, name: str = "p", arrival: bool = False) -> str:
    """CTEs of the trees over postings ``init`` (t, source, word, at), one for each t.

    name_scope: postings of every scope; name_e: expected words; name_n: nodes with node_id; name_h: HKTs with parent_node_id.
    """
    first = f"SELECT t, []::INTEGER[] AS path, source::BIGINT AS source, word::INTEGER AS word, \"at\"::BIGINT AS \"at\" FROM ({init})"
    base, every = first, f"{name}_r"
    lead = ""
    if arrival:  # the root by itself, then its branches and all below them
        lead = f"{name}_root AS ({first}),\n{_nodes(f'{name}_root', f'{name}_ar', True)},\n"
        base = f"SELECT * FROM ({_below(f'{name}_root', f'{name}_ar_n')})"
    body = f"""{lead}{name}_r AS (
  {base}
  UNION ALL
  SELECT * FROM (WITH {name}_w AS (SELECT * FROM {name}_r), {_nodes(f"{name}_w", f"{name}_i")} {_below(f"{name}_w", f"{name}_i_n")})),
{_nodes(every, f"{name}_x")},
"""
    pick = lambda kind, cols: f"SELECT {cols} FROM {name}_x_{kind}" + (f" UNION ALL SELECT {cols} FROM {name}_ar_{kind}" if arrival else "")
    return f"""{body}{name}_scope AS (SELECT * FROM {name}_r{f" UNION ALL SELECT * FROM {name}_root" if arrival else ""}),
{name}_e AS ({pick("e", "t, path, word, df, fst, seed")}),
{name}_g AS ({pick("n", "t, path, ord, refuge, words, sources")}),
{name}_n AS (SELECT *, (row_number() OVER (PARTITION BY t ORDER BY path, ord))::INTEGER AS node_id, (dense_rank() OVER (PARTITION BY t ORDER BY path))::INTEGER AS hkt_id FROM {name}_g),
{name}_h AS (
  SELECT h.t, h.hkt_id, h.path, coalesce(n.node_id, 0)::INTEGER AS parent_node_id FROM (SELECT DISTINCT t, hkt_id, path FROM {name}_n) h
  LEFT JOIN {name}_n n ON n.t = h.t AND len(h.path) > 0 AND n.path = h.path[:-2] AND n.ord = h.path[-1])"""


BASE = f"WITH RECURSIVE {PAGES.lstrip()}"
#: The tree of the first seven batches.
BUILT = f"""{BASE},
{tree('SELECT 0 AS t, source, word, fst AS "at" FROM pdt JOIN pvoc USING (token) WHERE b < 7')}"""
#: Its words: own ones, and those that stand for a branching node.
WORDS = f""",
p_own AS (SELECT node_id, hkt_id, path, ord, unnest(words) AS word, len(words) AS size FROM p_n WHERE NOT refuge),
p_d AS (SELECT path, word, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, min("at")) AS r FROM p_scope GROUP BY path, word),
p_top AS (
  SELECT node_id, o.word FROM p_own o WHERE list_append(o.path, o.ord) IN (SELECT path FROM p_h)
  UNION ALL SELECT n.node_id, d.word FROM p_n n JOIN p_d d ON d.path = list_append(n.path, n.ord) WHERE NOT n.refuge AND d.r <= greatest({TOP} - len(n.words), 0))"""
_NODE_ROWS = """SELECT n.node_id, hkt_id, ord, refuge, len(sources)::BIGINT AS sources,
  (SELECT string_agg(token, ' ' ORDER BY token) FROM pvoc WHERE list_contains(n.words, pvoc.word)) AS words FROM p_n n"""

#: The same for every prefix of the batches, and for all of them.
PREFIXES = f"""{BASE},
{tree('SELECT k.t, source, word, fst AS "at" FROM pdt JOIN pall USING (token) JOIN (SELECT unnest(range(8)) AS t) k ON pdt.b <= k.t')}"""
WHOLE = f"""{BASE},
{tree('SELECT 0 AS t, source, word, fst AS "at" FROM pdt JOIN pall USING (token)')}"""

#: What is left of the tree when only pages of batch 6 are: dead nodes, and HKTs that lost all nodes or hang from a dead one.
_PRUNED = """,
act AS (SELECT source FROM psrc WHERE b = 6),
ws AS (SELECT n.node_id, s.source FROM p_n n JOIN p_scope s ON s.path = n.path AND list_contains(n.words, s.word) AND list_contains(n.sources, s.source)),
live AS (SELECT DISTINCT node_id FROM ws SEMI JOIN act USING (source) UNION SELECT node_id FROM (SELECT node_id, unnest(sources) AS source FROM p_n WHERE refuge) SEMI JOIN act USING (source)),
held AS (SELECT hkt_id, path FROM p_h WHERE EXISTS (SELECT 1 FROM p_n n WHERE n.hkt_id = p_h.hkt_id AND n.node_id IN (FROM live))),
steps AS (SELECT hkt_id, path, unnest(range(1, len(path) + 1)) AS k FROM p_h),
cut AS (SELECT hkt_id FROM p_h WHERE hkt_id NOT IN (SELECT hkt_id FROM held)
  UNION SELECT s.hkt_id FROM steps s JOIN p_n n ON n.path = s.path[:s.k - 1] AND n.ord = s.path[s.k] WHERE n.node_id NOT IN (FROM live) OR n.hkt_id NOT IN (SELECT hkt_id FROM held)),
stay AS (SELECT n.* FROM p_n n WHERE node_id IN (FROM live) AND hkt_id NOT IN (FROM cut))"""
#: The scope of a rebuild of the first HKT below the root: its pages, without the words of the node above.
_SCOPE = """,
goal AS (SELECT hkt_id, path, parent_node_id FROM p_h WHERE parent_node_id <> 0 ORDER BY hkt_id LIMIT 1),
gsrc AS (SELECT DISTINCT unnest(sources) AS source FROM p_n JOIN goal USING (hkt_id)),
above AS (SELECT unnest(words) AS word FROM p_n WHERE node_id = (SELECT parent_node_id FROM goal)),
gpost AS (SELECT d.source, v.word, d.token, d.fst AS "at" FROM pdt d JOIN pvoc v USING (token) WHERE b < 7 AND source IN (FROM gsrc) AND v.word NOT IN (FROM above))"""
REBUILT = f"""{BUILT}{_SCOPE},
{tree('SELECT 0 AS t, source, word, "at" FROM gpost', "q", arrival=True)},
dead AS (SELECT p_h.hkt_id FROM p_h, goal WHERE len(p_h.path) >= len(goal.path) AND p_h.path[:len(goal.path)] = goal.path),
most AS (SELECT (SELECT max(hkt_id) FROM p_h) AS h, (SELECT max(node_id) FROM p_n) AS n)"""

#: All HKTs two levels below the root, each with its pages and without the words of the two nodes above it.
FOREST = f"""{BUILT},
goal AS (SELECT hkt_id AS t, path, parent_node_id FROM p_h WHERE len(path) = 2),
gsrc AS (SELECT DISTINCT goal.t, unnest(sources) AS source FROM p_n n JOIN goal ON n.hkt_id = goal.t),
above AS (SELECT goal.t, unnest(words) AS word FROM goal JOIN p_n n ON (n.path = [] AND n.ord = goal.path[1]) OR (n.path = goal.path[:1] AND n.ord = goal.path[2])),
gpost AS (SELECT gsrc.t, d.source, v.word, d.fst AS "at" FROM pdt d JOIN pvoc v USING (token) JOIN gsrc USING (source) WHERE b < 7 AND NOT EXISTS (SELECT 1 FROM above a WHERE a.t = gsrc.t AND a.word = v.word)),
{tree('SELECT t, source, word, "at" FROM gpost', "q", arrival=True)},
dead AS (SELECT p_h.hkt_id FROM p_h JOIN goal ON len(p_h.path) >= 2 AND p_h.path[:2] = goal.path),
most AS (SELECT (SELECT max(hkt_id) FROM p_h) AS h, (SELECT max(node_id) FROM p_n) AS n)"""


def statements() -> dict[str, str]:
    named = "(SELECT string_agg(token, ', ' ORDER BY word) FROM pvoc WHERE list_contains(n.words, pvoc.word))"
    stats = lambda n, h: f"SELECT (SELECT count(*) FROM {h})::BIGINT AS total_hkts, (SELECT count(*) FROM {n})::BIGINT AS total_nodes, (SELECT count(*) FROM {n})::BIGINT AS rendered_nodes, 0::BIGINT AS skipped_nodes"
    words = f"""{BUILT}{WORDS}
      SELECT 'node' AS kind, node_id AS id, token FROM p_own JOIN pvoc USING (word) UNION ALL SELECT 'top', node_id, token FROM p_top JOIN pvoc USING (word)
      UNION ALL SELECT 'expected', hkt_id, token FROM p_e e JOIN p_h USING (path) JOIN pvoc ON pvoc.word = e.word WHERE e.word <> e.seed"""
    pairs = f"{BUILT} SELECT n.node_id, pvoc.token, s.source_id FROM p_n n JOIN p_scope c ON c.path = n.path AND list_contains(n.words, c.word) AND list_contains(n.sources, c.source) JOIN pvoc ON pvoc.word = c.word JOIN psrc s ON s.source = c.source"
    return {
        "tree_nodes": f"{BUILT} {_NODE_ROWS}",
        "tree_levels": f"{BUILT} {_NODE_ROWS}",
        "tree_words": words,
        "tree_pairs": pairs,
        "tree_ids": f"""{BUILT} SELECT hkt_id, parent_node_id, (SELECT min(node_id) FROM p_n n WHERE n.hkt_id = p_h.hkt_id)::INTEGER AS first_node, (SELECT count(*) FROM p_n n WHERE n.hkt_id = p_h.hkt_id)::BIGINT AS nodes FROM p_h""",
        "tree_stats": f"{BUILT} {stats('p_n', 'p_h')}",
        "tree_outline": f"""{BUILT},
          lines AS (
            SELECT path AS place, 1 AS kind, repeat('  ', 2 * len(path)) || 'HKT ' || hkt_id AS text FROM p_h
            UNION ALL SELECT list_append(path, ord), 0, repeat('  ', 2 * len(path) + 1) || 'node ' || node_id || ': ' || CASE WHEN refuge THEN '<REFUGE>' ELSE {named} END || ' (' || len(sources) || ' sources)' || CASE WHEN refuge THEN ' [REFUGE]' ELSE '' END FROM p_n n)
          SELECT (row_number() OVER (ORDER BY place, kind) - 1)::INTEGER AS line, text FROM lines""",
        "timeline_summary": f"{PREFIXES} SELECT t::INTEGER AS batch_index, (SELECT count(*) FROM p_h WHERE p_h.t = k.t)::BIGINT AS hkts, (SELECT count(*) FROM p_n WHERE p_n.t = k.t)::BIGINT AS nodes, (SELECT count(*) FROM psrc WHERE b <= k.t)::BIGINT AS sources FROM (SELECT unnest(range(8)) AS t) k",
        "full_rebuild": f"{WHOLE} SELECT node_id, len(sources)::BIGINT AS sources FROM p_n",
        "window_prune": f"{BUILT}{_PRUNED} SELECT node_id, hkt_id, ord, refuge, (SELECT count(*) FROM (SELECT unnest(sources) AS source) SEMI JOIN act USING (source))::BIGINT AS sources FROM stay",
        "window_batches": f"{BASE} SELECT b::INTEGER AS batch_index, least(b + 1, 3)::INTEGER AS stored, greatest(b - 2, 0)::INTEGER AS first_batch, (SELECT count(*) FROM psrc x WHERE x.b BETWEEN p.b - 2 AND p.b)::BIGINT AS sources FROM (SELECT DISTINCT b FROM psrc) p",
        "rebuild_scope": f"{BUILT}{_SCOPE} SELECT token, count(*)::BIGINT AS df FROM gpost GROUP BY token",
        "subtree_report": f"{REBUILT} SELECT (SELECT hkt_id FROM goal) AS target_hkt_id, (SELECT count(DISTINCT source) FROM gpost)::BIGINT AS scoped_source_count, (SELECT count(*) FROM q_h)::BIGINT AS subtree_hkt_count, (SELECT count(*) FROM q_n)::BIGINT AS subtree_node_count, 0::BIGINT AS new_token_count_in_scope",
        "tree_scopes": f"""{BUILT},
          s AS (SELECT path, sha256(string_agg(source || ':' || word, ',' ORDER BY source, word)) AS posts FROM p_scope GROUP BY path)
          SELECT len(path)::INTEGER AS depth, count(*)::BIGINT AS hkts, count(DISTINCT posts)::BIGINT AS scopes FROM s GROUP BY len(path)""",
        "forest_rebuild": f"""{FOREST},
          placed AS (SELECT t, path, ord, refuge, words, sources, (row_number() OVER (ORDER BY t, path, ord) + most.n)::INTEGER AS node_id, (dense_rank() OVER (ORDER BY t, path) + most.h)::INTEGER AS hkt_id FROM q_g, most),
          n AS (SELECT node_id, hkt_id, ord, refuge, words, sources FROM p_n WHERE hkt_id NOT IN (FROM dead) UNION ALL SELECT node_id, hkt_id, ord, refuge, words, sources FROM placed),
          up AS (SELECT hkt_id, parent_node_id FROM p_h WHERE hkt_id NOT IN (FROM dead)
            UNION ALL SELECT h.hkt_id, (CASE WHEN h.path = [] THEN goal.parent_node_id ELSE a.node_id END)::INTEGER FROM (SELECT DISTINCT t, hkt_id, path FROM placed) h JOIN goal USING (t)
              LEFT JOIN placed a ON a.t = h.t AND len(h.path) > 0 AND a.path = h.path[:-2] AND a.ord = h.path[-1])
          SELECT n.node_id, n.hkt_id, up.parent_node_id, ord, refuge, len(sources)::BIGINT AS sources, (SELECT string_agg(token, ' ' ORDER BY token) FROM pvoc WHERE list_contains(n.words, pvoc.word)) AS words FROM n JOIN up USING (hkt_id)""",
        "subtree_rebuild": f"""{REBUILT},
          moved AS (SELECT (node_id + most.n)::INTEGER AS node_id, (hkt_id + most.h)::INTEGER AS hkt_id, ord, refuge, words, sources FROM q_n, most),
          n AS (SELECT node_id, hkt_id, ord, refuge, words, sources FROM p_n WHERE hkt_id NOT IN (FROM dead) UNION ALL SELECT * FROM moved),
          up AS (SELECT hkt_id, parent_node_id FROM p_h WHERE hkt_id NOT IN (FROM dead)
            UNION ALL SELECT (q_h.hkt_id + most.h)::INTEGER, (CASE WHEN q_h.parent_node_id = 0 THEN (SELECT parent_node_id FROM goal) ELSE q_h.parent_node_id + most.n END)::INTEGER FROM q_h, most)
          SELECT n.node_id, n.hkt_id, up.parent_node_id, ord, refuge, len(sources)::BIGINT AS sources, (SELECT string_agg(token, ' ' ORDER BY token) FROM pvoc WHERE list_contains(n.words, pvoc.word)) AS words FROM n JOIN up USING (hkt_id)""",
    }
