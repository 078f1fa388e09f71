"""DuckDB SQL for the recursive plan over the tree of ``pages``: every level of HKTs that the last batch reaches, one after the other."""

from __future__ import annotations

from driftgrove.plans.tree_sql import BUILT

ALPHA = BETA = 0.5
#: Levels that the SQL covers; a plan that went deeper would differ.
LEVELS = 9

#: The tree as tables by token; base and last: tokens of the first seven batches and of the eighth.
_TABLES = """,
H AS (SELECT hkt_id AS hkt, parent_node_id AS parent FROM p_h),
N AS (SELECT node_id AS node, hkt_id AS hkt, ord, refuge FROM p_n),
NW AS (SELECT node, token, word FROM (SELECT node_id AS node, unnest(words) AS word FROM p_n WHERE NOT refuge) JOIN pvoc USING (word)),
NS AS (SELECT node_id AS node, unnest(sources) AS source FROM p_n),
base AS (SELECT source, token FROM pdt WHERE b < 7),
last AS (SELECT source, token FROM pdt WHERE b = 7),
WS AS (SELECT NS.node, NW.token, NS.source FROM NS JOIN NW USING (node) JOIN base USING (source, token)),
EX AS (SELECT hkt_id AS hkt, token FROM p_e x JOIN p_h USING (path) JOIN pvoc ON pvoc.word = x.word WHERE x.word <> x.seed),
L0_front AS (SELECT (SELECT min(hkt) FROM H WHERE parent = 0) AS hkt, source FROM psrc WHERE b = 7),
L0_acc AS (SELECT 0 AS hkt, '' AS token WHERE false)"""


def _round(c: str) -> str:
    return f"(floor(abs({c}) * 10000 + 0.5) / 10000) * sign({c})"


def level(d: int, limits: tuple[float, float, float]) -> str:
    """CTEs of level ``d``, from its front (hkt, source) and the words accepted above (hkt, token) to the front of the next one."""
    p, a, b, w = f"L{d}", *limits
    return f""",
{p}_hk AS (SELECT DISTINCT hkt, parent FROM {p}_front JOIN H USING (hkt)),
{p}_n AS (SELECT N.* FROM N SEMI JOIN {p}_hk USING (hkt)),
{p}_w AS (SELECT hkt, node, ord, token, word FROM {p}_n JOIN NW USING (node) WHERE NOT refuge),
{p}_hit AS (SELECT DISTINCT hkt, node, source FROM {p}_front JOIN last USING (source) JOIN {p}_w USING (hkt, token)),
{p}_routed AS (SELECT * FROM {p}_hit UNION ALL SELECT f.hkt, n.node, f.source FROM ({p}_front f ANTI JOIN {p}_hit h ON h.hkt = f.hkt AND h.source = f.source) JOIN {p}_n n ON n.hkt = f.hkt AND n.refuge),
{p}_df1 AS (SELECT hkt, token, count(*) AS df1 FROM {p}_front JOIN last USING (source) GROUP BY ALL),
{p}_df0 AS (
  SELECT hkt, token, count(*) AS df0 FROM {p}_hk, base WHERE parent = 0 GROUP BY ALL
  UNION ALL SELECT hkt, token, count(*) FROM {p}_hk JOIN NS ON NS.node = parent JOIN base USING (source) WHERE parent <> 0 GROUP BY ALL),
{p}_s0 AS (SELECT hkt, node, token, source FROM {p}_n JOIN WS USING (node) WHERE NOT refuge),
{p}_s1 AS (SELECT hkt, node, token, source FROM {p}_routed JOIN last USING (source)),
{p}_n0 AS (SELECT node, token, count(*) AS n0 FROM {p}_s0 GROUP BY ALL),
{p}_n1 AS (SELECT node, token, count(*) AS n1 FROM {p}_s1 GROUP BY ALL),
{p}_own AS (SELECT x.*, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1 FROM {p}_w x LEFT JOIN {p}_n0 USING (node, token) LEFT JOIN {p}_n1 USING (node, token)),
{p}_lead AS (SELECT hkt, arg_min(n0, {{'o': ord, 'w': word}}) AS lead FROM {p}_own GROUP BY hkt),
{p}_held AS (SELECT hkt, token FROM {p}_w UNION SELECT hkt, token FROM {p}_acc),
{p}_tot AS (SELECT hkt, token, coalesce(df0, 0) + coalesce(df1, 0) AS total, df1 FROM {p}_df1 FULL JOIN {p}_df0 USING (hkt, token)),
{p}_adm AS (SELECT t.hkt, t.token FROM ({p}_tot t ANTI JOIN {p}_held h ON h.hkt = t.hkt AND h.token = t.token) LEFT JOIN {p}_lead l ON l.hkt = t.hkt WHERE t.df1 IS NOT NULL AND t.total / greatest(coalesce(l.lead, 1), 1) >= {ALPHA}),
{p}_e1 AS (SELECT hkt, token, coalesce(total, 0) AS total FROM (SELECT EX.* FROM EX SEMI JOIN {p}_hk USING (hkt) UNION SELECT * FROM {p}_adm) LEFT JOIN {p}_tot USING (hkt, token)),
{p}_most AS (SELECT hkt, greatest(max(n), 1) AS most FROM (SELECT hkt, n0 + n1 AS n FROM {p}_own UNION ALL SELECT hkt, total FROM {p}_e1) GROUP BY hkt),
{p}_e AS (SELECT hkt, token, total FROM {p}_e1 JOIN {p}_most USING (hkt) WHERE total / most >= {ALPHA}),
{p}_tog AS (SELECT DISTINCT x.node, x.token, source, word FROM (SELECT node, token, source FROM {p}_s0 UNION ALL SELECT node, token, source FROM {p}_s1) x JOIN {p}_w USING (node, token)),
{p}_best AS (SELECT node, token FROM (SELECT node, token, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, word) AS r FROM {p}_tog GROUP BY node, token, word) WHERE r = 1),
{p}_mat AS (SELECT r.* FROM {p}_routed r JOIN {p}_n n USING (node) WHERE NOT n.refuge),
{p}_prom AS (SELECT DISTINCT node, source FROM (SELECT node, source FROM {p}_tog SEMI JOIN {p}_best USING (node, token) UNION ALL SELECT node, source FROM {p}_mat ANTI JOIN {p}_best USING (node))),
{p}_size AS (SELECT node, count(*) AS size FROM {p}_prom GROUP BY node),
{p}_asg AS (
  SELECT s.hkt, s.node, s.token FROM {p}_s1 s JOIN {p}_e e ON e.hkt = s.hkt AND e.token = s.token LEFT JOIN {p}_prom m ON m.node = s.node AND m.source = s.source LEFT JOIN {p}_size z ON z.node = s.node
  WHERE s.node IN (SELECT node FROM {p}_mat) GROUP BY s.hkt, s.node, s.token HAVING count(m.source) / greatest(coalesce(any_value(size), 1), 1) >= {BETA}),
{p}_per AS (
  SELECT hkt, greatest(coalesce(a1, 0) + coalesce(es, 0), 1) AS all1, greatest(coalesce(m, 0), coalesce(em, 0), 1) AS p1
  FROM {p}_hk LEFT JOIN (SELECT hkt, sum(n0 + n1) AS a1, max(n0 + n1) AS m FROM {p}_own GROUP BY hkt) USING (hkt) LEFT JOIN (SELECT hkt, sum(total) AS es, max(total) AS em FROM {p}_e GROUP BY hkt) USING (hkt)),
{p}_in AS (SELECT hkt, node, token FROM {p}_w UNION SELECT hkt, node, token FROM {p}_asg),
{p}_side AS (SELECT node, source FROM NS SEMI JOIN {p}_n USING (node) UNION SELECT node, source FROM {p}_routed),
{p}_mix AS (SELECT DISTINCT node, token, source FROM (SELECT node, token, source FROM {p}_s0 UNION ALL SELECT node, token, source FROM {p}_s1)),
{p}_by AS (SELECT x.node, x.token, count(*) AS after, count(i.source) AS c1 FROM {p}_mix x LEFT JOIN {p}_side i ON i.node = x.node AND i.source = x.source GROUP BY x.node, x.token),
{p}_z1 AS (SELECT node, count(*) AS z1 FROM {p}_side GROUP BY node),
{p}_chg AS (
  SELECT hkt, token, coalesce(after, 0) / p1 AS strength1, coalesce(c1, 0) / greatest(coalesce(z1, 0), 1) AS eligibility1, coalesce(after, 0) / all1 AS importance1
  FROM (SELECT *, row_number() OVER (PARTITION BY hkt, token ORDER BY node DESC) AS r FROM {p}_in) LEFT JOIN {p}_by USING (node, token) LEFT JOIN {p}_z1 USING (node) JOIN {p}_per USING (hkt) WHERE r = 1),
{p}_err AS (
  SELECT hkt, {_round(f"coalesce(sum(greatest({ALPHA} - strength1, 0)) / count(strength1), 0)")} AS a, {_round(f"coalesce(sum(greatest({BETA} - eligibility1, 0)) / count(strength1), 0)")} AS b, {_round("(1 - coalesce(sum(importance1), 0))")} AS w
  FROM {p}_hk LEFT JOIN {p}_chg USING (hkt) GROUP BY hkt),
{p}_dec AS (
  SELECT hkt, k, a, b, w, concat_ws(',', CASE WHEN w > {w} THEN 'word_importance' END, CASE WHEN a > {a} THEN 'alpha' END, CASE WHEN b > {b} THEN 'beta' END, CASE WHEN k <= 1 AND (w > {w} OR a > {a} OR b > {b}) THEN 'tiny' END) AS reasons
  FROM {p}_err JOIN (SELECT hkt, count(*) AS k FROM {p}_front GROUP BY hkt) USING (hkt)),
{p}_down AS (SELECT n.hkt, n.node, H.hkt AS child FROM {p}_n n JOIN {p}_dec USING (hkt) JOIN H ON H.parent = n.node WHERE reasons = ''),
L{d + 1}_front AS (SELECT child AS hkt, source FROM {p}_down JOIN {p}_routed USING (node)),
L{d + 1}_acc AS (
  SELECT child AS hkt, token FROM {p}_down x JOIN {p}_acc c ON c.hkt = x.hkt UNION SELECT child, token FROM {p}_down JOIN (SELECT node, token FROM {p}_w UNION ALL SELECT node, token FROM {p}_asg) USING (node))"""


def plan(limits: tuple[float, float, float]) -> str:
    """Decisions with the thresholds of the first options of alpha, beta and word importance."""
    a, b, w = limits
    rows = " UNION ALL ".join(f"SELECT * FROM L{d}_dec" for d in range(LEVELS))
    return f"""{BUILT}{_TABLES}{"".join(level(d, limits) for d in range(LEVELS))}
      SELECT hkt AS hkt_id, k::BIGINT AS scoped_sources, a AS alpha_error, b AS beta_error, w AS wi_error, {a}::DOUBLE AS alpha_threshold, {b}::DOUBLE AS beta_threshold, {w}::DOUBLE AS wi_threshold, reasons, reasons <> '' AS triggered FROM ({rows})"""
