"""Queries over models with bifurcations, from structures that Spark derives from the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.operators import models, trees
from helixlake.sources import tables


def _structures(spark: SparkSession, d: str) -> DataFrame:
    """A structure for each part: up to three helices with loops, spacers between them, inside an outer helix of up to two pairs."""
    size, key = F.col("p_size"), F.col("p_partkey")
    many = lambda text, n: F.expr(f"repeat('{text}', CAST({n} AS INT))")
    helix = "concat(repeat(',', CAST((p_partkey + r) % 2 AS INT)), repeat('<', CAST(1 + (p_partkey + r) % 3 AS INT)), repeat('_', 3 + r), repeat('>', CAST(1 + (p_partkey + r) % 3 AS INT)))"
    helices = F.expr(f"array_join(transform(filter(sequence(0, 2), r -> r < p_size % 4), r -> {helix}), '')")
    structure = F.concat(many(":", "p_partkey % 2"), many("(", "p_size % 3"), helices, many(",", "p_size % 5"), many(")", "p_size % 3"), many(":", "p_size % 2"))
    return tables.table(spark, d, "part").filter(size.isNotNull()).select(key.alias("model"), structure.alias("structure"))


def _trees(spark: SparkSession, d: str) -> DataFrame:
    return trees.guide_trees(_structures(spark, d))


def guide_trees(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d)


def tree_states(spark: SparkSession, d: str) -> DataFrame:
    """All states of models with bifurcations, their children and their parents."""
    return models.linked(_trees(spark, d)).select("model", "v", "nd", "node", "state", "cfirst", "cnum", "plast", "pnum")


def tree_emit_map(spark: SparkSession, d: str) -> DataFrame:
    return trees.emit_map(_trees(spark, d))


def tree_summary(spark: SparkSession, d: str) -> DataFrame:
    return models.summary(_trees(spark, d))


def length_bands(spark: SparkSession, d: str) -> DataFrame:
    """The length bands of every state of every part's model, with transitions that favour the first state of each node."""
    nodes = _trees(spark, d)
    return trees.length_bands(nodes, trees.transitions(trees.states(nodes)))


QUERIES = {f.__name__: f for f in (guide_trees, tree_states, tree_emit_map, tree_summary, length_bands)}

# Pairs by order of brackets at one depth; all splits of neighbouring helices; then the walk from the root downwards.
_WALK = """WITH RECURSIVE st AS (SELECT p_partkey AS model, repeat(':', p_partkey % 2) || repeat('(', p_size % 3) || array_to_string(list_transform(range(p_size % 4), lambda r:
    repeat(',', (p_partkey + r) % 2) || repeat('<', 1 + (p_partkey + r) % 3) || repeat('_', 3 + r) || repeat('>', 1 + (p_partkey + r) % 3)), '')
    || repeat(',', p_size % 5) || repeat(')', p_size % 3) || repeat(':', p_size % 2) AS s FROM part WHERE p_size IS NOT NULL),
  ch AS (SELECT model, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS pos FROM st WHERE s <> ''),
  dp AS (SELECT model, pos, c IN ('<', '(') AS op, sum(CASE WHEN c IN ('<', '(') THEN 1 WHEN c IN ('>', ')') THEN -1 ELSE 0 END) OVER (PARTITION BY model ORDER BY pos) + (c IN ('>', ')'))::INT AS depth
    FROM ch WHERE c IN ('<', '(', '>', ')')),
  nb AS (SELECT *, row_number() OVER (PARTITION BY model, depth, op ORDER BY pos) AS k FROM dp),
  pr AS (SELECT a.model, a.depth, a.pos AS i, b.pos AS j FROM nb a JOIN nb b ON a.model = b.model AND a.depth = b.depth AND a.k = b.k AND a.op AND NOT b.op),
  ct AS (SELECT model, i AS pos, j AS partner FROM pr UNION ALL SELECT model, j, i FROM pr),
  best AS (SELECT a.model, a.i, b.j, arg_min(c.j + 1, abs((c.j + 1 - a.i) - (b.j - c.j)) * 100000 + c.j) AS k FROM pr a JOIN pr b ON a.model = b.model AND a.depth = b.depth AND a.i < b.i
    JOIN pr c ON c.model = a.model AND c.depth = a.depth AND c.i >= a.i AND c.j < b.i GROUP BY a.model, a.i, b.j),
  walk AS (SELECT model, '0' AS path, 'ROOT' AS typ, 1::BIGINT AS i, len(s)::BIGINT AS j FROM st
    UNION ALL SELECT model, x.path, x.typ, x.i, x.j FROM (SELECT w.model, unnest(CASE
      WHEN w.typ <> '' THEN [{'path': w.path || '0', 'typ': '', 'i': w.i, 'j': w.j}] WHEN w.i > w.j THEN []
      WHEN a.partner IS NULL THEN [{'path': w.path || '0', 'typ': '', 'i': w.i + 1, 'j': w.j}] WHEN b.partner IS NULL THEN [{'path': w.path || '0', 'typ': '', 'i': w.i, 'j': w.j - 1}]
      WHEN a.partner = w.j THEN [{'path': w.path || '0', 'typ': '', 'i': w.i + 1, 'j': w.j - 1}]
      ELSE [{'path': w.path || '0', 'typ': 'BEGL', 'i': w.i, 'j': s.k - 1}, {'path': w.path || '1', 'typ': 'BEGR', 'i': s.k, 'j': w.j}] END) AS x
      FROM walk w LEFT JOIN ct a ON a.model = w.model AND a.pos = w.i LEFT JOIN ct b ON b.model = w.model AND b.pos = w.j LEFT JOIN best s ON s.model = w.model AND s.i = w.i AND s.j = w.j)),
  named AS (SELECT w.*, (row_number() OVER (PARTITION BY w.model ORDER BY path) - 1)::INT AS nd, CASE WHEN typ <> '' THEN typ WHEN w.i > w.j THEN 'END' WHEN a.partner IS NULL THEN 'MATL'
    WHEN b.partner IS NULL THEN 'MATR' WHEN a.partner = w.j THEN 'MATP' ELSE 'BIF' END AS node
    FROM walk w LEFT JOIN ct a ON a.model = w.model AND a.pos = w.i LEFT JOIN ct b ON b.model = w.model AND b.pos = w.j),
  nodes AS (SELECT n.model, n.nd, n.node, coalesce(p.nd, -1) AS parent, n.i::INT AS i, n.j::INT AS j FROM named n LEFT JOIN named p ON p.model = n.model AND p.path = left(n.path, -1))"""
_KINDS = "kinds(node, k, state) AS (VALUES " + ", ".join(f"('{n}', {i}, '{s}')" for n, v in models.STATES.items() for i, s in enumerate(v)) + ")"
# A state leads to inserts of its own node (not before itself) and to the entered states of the nodes below its own.
_STATES = f"""{_WALK}, {_KINDS}, states AS (SELECT model, (row_number() OVER (PARTITION BY model ORDER BY nd, k) - 1)::INT AS v, nd, node, parent, k, state, state IN ('IL', 'IR') AS ins FROM nodes JOIN kinds USING (node)),
  e AS (SELECT a.model, a.v AS u, a.state, b.v FROM states a JOIN states b ON a.model = b.model AND b.nd = a.nd AND b.ins AND (NOT a.ins OR b.v >= a.v)
    UNION ALL SELECT a.model, a.v, a.state, b.v FROM states a JOIN states b ON a.model = b.model AND b.parent = a.nd AND NOT b.ins)"""

ORACLE_SQL = {
    "guide_trees": _WALK + " SELECT * FROM nodes",
    "tree_states": _STATES
    + """, c AS (SELECT model, u AS v, min(v) AS cfirst, (CASE WHEN any_value(state) = 'B' THEN max(v) ELSE count(*) END)::INT AS cnum FROM e GROUP BY ALL), p AS (SELECT model, v, max(u) AS plast, count(*) AS pnum FROM e GROUP BY ALL)
  SELECT s.model, s.v, nd, node, state, coalesce(cfirst, -1) AS cfirst, coalesce(cnum, 0) AS cnum, coalesce(plast, -1) AS plast, coalesce(pnum, 0) AS pnum
  FROM states s LEFT JOIN c ON c.model = s.model AND c.v = s.v LEFT JOIN p ON p.model = s.model AND p.v = s.v""",
    "tree_emit_map": _WALK
    + """ SELECT model, nd, node, i - 1 + (node IN ('MATP', 'MATL'))::INT AS lpos, j + 1 - (node IN ('MATP', 'MATR'))::INT AS rpos FROM nodes n""",
    "tree_summary": _STATES
    + """ SELECT model, count(DISTINCT nd) AS nodes, count(*) AS states, sum(CASE WHEN k > 0 THEN 0 WHEN node = 'MATP' THEN 2 WHEN node IN ('MATL', 'MATR') THEN 1 ELSE 0 END)::BIGINT AS clen,
  count(*) FILTER (k = 0 AND node = 'MATP') AS pairs, count(*) FILTER (k = 0 AND node = 'BIF') AS bifurcations FROM states GROUP BY ALL""",
}
