"""Queries of the general problems: heavy keys (2), hierarchies (5) and orphan references (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import hierarchy as H
from weftgraph.operators import orphans as O
from weftgraph.operators import skew as K
from weftgraph.tables import live_ids, load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    edges = load(spark, d, "code_edges").select("source", "target")
    return K.heavy_keys(edges, ["source", "target"], share="1/100").select("ref_column", "node_id")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.key_counts(load(spark, d, "code_edges").select("source", "target"), ["source", "target"])


def p2_weight_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of the edge weight for every target."""
    edges = load(spark, d, "code_edges").select(F.col("target").alias("node_id"), "weight")
    return K.key_quantiles(edges, ["node_id"], "weight", [0.25, 0.5, 0.75])


def p2_ord_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and 90 % point of the order of arrival for every target: all values of a hot key differ."""
    edges = load(spark, d, "code_edges").select(F.col("target").alias("node_id"), "ord")
    return K.key_quantiles(edges, ["node_id"], "ord", [0.5, 0.9]).select("node_id", "q", F.col("v").cast("long").alias("v"))


def _live_links(spark: SparkSession, d: str, kinds: list[str], child: str, parent: str) -> DataFrame:
    edges = load(spark, d, "code_edges").where(F.col("kind").isin(kinds) & F.col("source").isNotNull() & F.col("target").isNotNull())
    # Where two parents contain a child, the one of the later kind is nearer: a class and not its file.
    rank = F.min(-F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))).alias("rank")
    links = edges.groupBy(F.col(child).alias("child"), F.col(parent).alias("parent")).agg(rank)
    ends = links.select(F.col("child").alias("id")).union(links.select("parent")).distinct()
    nodes = load(spark, d, "code_nodes").select("id", "indexed_at").join(ends, "id", "left_semi")
    live = live_ids(nodes, load(spark, d, "node_removals").select("node_id", "removed_at"))
    live = live.select(F.col("id").alias("__live"))
    return links.join(live, F.col("child") == F.col("__live"), "left_semi").join(live, F.col("parent") == F.col("__live"), "left_semi")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(_live_links(spark, d, ["extends"], "source", "target")).select("id", "root_id", "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = H.hierarchy(_live_links(spark, d, ["extends"], "source", "target"), between=" > ")
    return tree.select("id", "root_id", "depth", (F.col("size") - 1).alias("n_descendants")).join(H.paths(tree), "id", "left")


def p5_containment(spark: SparkSession, d: str) -> DataFrame:
    """The containment hierarchy: files over classes over members, with the number of nodes below each."""
    tree = H.hierarchy(_live_links(spark, d, ["contains", "has_member"], "target", "source"))
    return tree.select("id", "root_id", "depth", (F.col("size") - 1).alias("n_descendants"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node that has any."""
    tree = H.hierarchy(_live_links(spark, d, ["extends"], "source", "target"))
    return H.descendants(tree, tree.where("size > 1"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    edges = load(spark, d, "code_edges").select("ord", "source", "target", "indexed_at")
    contracts = load(spark, d, "contracts").select("ord", "node_id", "indexed_at")
    return O.references(edges, "code_edges", ["source", "target"]).unionByName(O.references(contracts, "contracts", ["node_id"]))


def _deltas(spark: SparkSession, d: str, refs: DataFrame) -> list[DataFrame]:
    return [O.reference_deltas(refs), O.node_deltas(load(spark, d, "code_nodes").select("id", "indexed_at")), O.removal_deltas(load(spark, d, "node_removals").select("node_id", "removed_at"))]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    refs = _references(spark, d)
    return O.orphan_references(refs, O.Ledger(spark).apply(*_deltas(spark, d, refs))).select("table_name", "ref_column", "ord")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    refs = _references(spark, d)
    return O.orphan_report(refs, O.Ledger(spark).apply(*_deltas(spark, d, refs)))


def p7_maintained(spark: SparkSession, d: str) -> DataFrame:
    """Orphan keys by a ledger that is brought up to date: first all rows that arrived in even order, with every node
    row twice and no removal; then the odd ones, the removals, and the doubled node rows withdrawn."""
    refs = _references(spark, d)
    nodes = load(spark, d, "code_nodes").select("id", "indexed_at")
    removals = load(spark, d, "node_removals").select("node_id", "removed_at")
    ledger = O.Ledger(spark)
    ledger.apply(O.reference_deltas(refs.where("ord % 2 = 0")), O.node_deltas(nodes), O.node_deltas(nodes))
    ledger.apply(O.reference_deltas(refs.where("ord % 2 <> 0")), O.removal_deltas(removals))
    return O.orphan_keys(ledger.apply(O.node_deltas(nodes, sign=-1)))


QUERIES = {q.__name__: q for q in (p2_found, p2_counts, p2_weight_quantiles, p2_ord_quantiles, p5_found, p5_paths, p5_descendants, p5_containment, p7_found, p7_report, p7_maintained)}

_LIVE = """live AS (
  SELECT n.id FROM (SELECT id, max(indexed_at) i FROM code_nodes WHERE id IS NOT NULL GROUP BY id) n
  LEFT JOIN (SELECT node_id, max(removed_at) r FROM node_removals GROUP BY node_id) x ON x.node_id = n.id
  WHERE x.node_id IS NULL OR n.i > x.r)"""

_REFS = """refs AS (
  SELECT 'code_edges' AS table_name, 'source' AS ref_column, ord, source AS key, indexed_at FROM code_edges WHERE source IS NOT NULL
  UNION ALL SELECT 'code_edges', 'target', ord, target, indexed_at FROM code_edges WHERE target IS NOT NULL
  UNION ALL SELECT 'contracts', 'node_id', ord, node_id, indexed_at FROM contracts WHERE node_id IS NOT NULL)"""


def _tree_sql(kinds: str, child: str, parent: str, with_path: bool) -> str:
    return f"""WITH RECURSIVE {_LIVE},
links AS (SELECT {child} AS id, arg_min({parent}, (CASE kind WHEN 'has_member' THEN 0 ELSE 1 END, {parent})) AS parent FROM code_edges
  WHERE kind IN ({kinds}) AND {child} IN (SELECT id FROM live) AND {parent} IN (SELECT id FROM live) GROUP BY 1),
ids AS (SELECT id FROM links UNION SELECT parent FROM links),
walk AS (
  SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, id AS path FROM ids WHERE id NOT IN (SELECT id FROM links)
  UNION ALL SELECT l.id, w.root_id, w.depth + 1, w.path || ' > ' || l.id FROM walk w JOIN links l ON l.parent = w.id),
up AS (
  SELECT id, id AS anc FROM walk UNION ALL SELECT u.id, l.parent FROM up u JOIN links l ON l.id = u.anc),
sizes AS (SELECT anc AS id, CAST(count(*) - 1 AS BIGINT) AS n FROM up GROUP BY anc)
SELECT i.id, coalesce(w.root_id, '(cycle)') AS root_id, coalesce(w.depth, -1) AS depth, s.n AS n_descendants{", w.path AS path" if with_path else ""}
FROM ids i LEFT JOIN walk w ON w.id = i.id LEFT JOIN sizes s ON s.id = i.id"""


def _quantile_sql(value: str, cast: str, qs: str) -> str:
    return f"""WITH r AS (SELECT target AS node_id, {value} AS x, row_number() OVER (PARTITION BY target ORDER BY {value}) AS k, count(*) OVER (PARTITION BY target) AS n
  FROM code_edges WHERE target IS NOT NULL AND {value} IS NOT NULL)
SELECT node_id, CAST(q AS DOUBLE) AS q, CAST(x AS {cast}) AS v FROM r, (VALUES {qs}) AS t(q) WHERE k = greatest(1, ceil(CAST(q AS DOUBLE) * n))"""


SQL = {
    "p2_found": """WITH k AS (SELECT 'source' AS ref_column, source AS node_id FROM code_edges UNION ALL SELECT 'target', target FROM code_edges)
SELECT ref_column, node_id FROM k WHERE node_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 100 >= (SELECT count(*) FROM code_edges)""",
    "p2_counts": """SELECT 'source' AS ref_column, source AS node_id, count(*) AS n_rows, count(DISTINCT target) AS n_other FROM code_edges WHERE source IS NOT NULL GROUP BY 2
UNION ALL SELECT 'target', target, count(*), count(DISTINCT source) FROM code_edges WHERE target IS NOT NULL GROUP BY 2""",
    "p2_weight_quantiles": _quantile_sql("weight", "DOUBLE", "(0.25), (0.5), (0.75)"),
    "p2_ord_quantiles": _quantile_sql("ord", "BIGINT", "(0.5), (0.9)"),
    "p5_found": f"SELECT id, root_id, depth FROM ({_tree_sql("'extends'", 'source', 'target', False)})",
    "p5_paths": _tree_sql("'extends'", "source", "target", True),
    "p5_containment": _tree_sql("'contains', 'has_member'", "target", "source", False),
    "p5_descendants": f"""WITH RECURSIVE {_LIVE},
links AS (SELECT source AS id, min(target) AS parent FROM code_edges WHERE kind = 'extends' AND source IN (SELECT id FROM live) AND target IN (SELECT id FROM live) GROUP BY 1),
walk AS (SELECT id FROM (SELECT parent AS id FROM links) WHERE id NOT IN (SELECT id FROM links) UNION SELECT l.id FROM walk w JOIN links l ON l.parent = w.id),
up AS (SELECT parent AS ancestor, id FROM links WHERE id IN (SELECT id FROM walk) UNION ALL SELECT l.parent, u.id FROM up u JOIN links l ON l.id = u.ancestor)
SELECT ancestor, id FROM up""",
    "p7_maintained": f"WITH {_LIVE}, {_REFS} SELECT key, count(*) AS refs FROM refs WHERE key NOT IN (SELECT id FROM live) GROUP BY key",
    "p7_found": f"WITH {_LIVE}, {_REFS} SELECT table_name, ref_column, ord FROM refs WHERE key NOT IN (SELECT id FROM live)",
    "p7_report": f"""WITH {_LIVE}, {_REFS} SELECT table_name, ref_column, strftime(indexed_at, '%Y-%m') AS month, count(*) AS n_refs,
CAST(sum(CASE WHEN l.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_orphans FROM refs r LEFT JOIN live l ON l.id = r.key GROUP BY 1, 2, 3""",
}
