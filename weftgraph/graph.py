"""The property graph: nodes and edges as DataFrames, and the SQL that names the same rows.

A node is the current version of its id; ``ord`` is the first arrival of the id, which stands for insertion
order wherever "the first" matters. An edge is a distinct (source, kind, target); rows with a null end or kind
are no edges. Ends without a node are allowed and each operator says what it does with them.

The graph of a set of input tables is published once on the shared file system (``sources.published``), partitioned
by kind, and read from there: queries scan the columns and kinds they need and shuffle no versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import ship_package
from weftgraph.sources.published import published
from weftgraph.tables import load

NODE_KINDS = ["file", "directory", "function", "class", "interface", "method", "constructor", "variable", "property", "struct", "enum", "trait", "namespace", "module", "type_alias", "constant", "route", "cluster", "flow", "vulnerability"]
EDGE_KINDS = ["contains", "calls", "imports", "extends", "implements", "has_member", "accesses", "overrides", "belongs_to", "step_of", "handles", "has_vulnerability", "deprecated_use", "tested_by"]
NODE_COLUMNS = ["id", "repo", "ord", "kind", "name", "file_path", "start_line", "end_line", "exported", "content", "metadata"]
SUFFIX_LANGUAGE = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python",
    "java": "java", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "rs": "rust", "php": "php", "kt": "kotlin", "kts": "kotlin", "rb": "ruby", "swift": "swift", "dart": "dart", "html": "html",
}


def node_id(kind: Column, path: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, path, name)


def nodes(spark: SparkSession, d: str, columns: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Current nodes with the named columns; only these, and of the kinds only those asked for, are read."""
    rows = _graph(spark, d, "code_nodes", lambda: current_nodes(load(spark, d, "code_nodes"), NODE_COLUMNS))
    return (rows if kinds is None else rows.where(F.col("kind").isin(kinds))).select(*columns)


def current_nodes(rows: DataFrame, columns: list[str]) -> DataFrame:
    kept = [c for c in columns if c not in ("id", "ord")]
    best = F.max(F.struct("indexed_at", F.col("ord").alias("__o"), *kept)).alias("v")
    out = rows.where(F.col("id").isNotNull()).groupBy("id").agg(best, F.min("ord").alias("ord"))
    return out.select("id", "ord", *[F.col(f"v.{c}").alias(c) for c in kept]).select(*columns)


def edges(spark: SparkSession, d: str, kinds: list[str] | None = None) -> DataFrame:
    """``source, kind, target, ord``; only the kinds asked for are read."""
    rows = _graph(spark, d, "code_edges", lambda: distinct_edges(load(spark, d, "code_edges")))
    return (rows if kinds is None else rows.where(F.col("kind").isin(kinds))).select("source", "kind", "target", "ord")


def distinct_edges(rows: DataFrame) -> DataFrame:
    whole = rows.where(F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("kind").isNotNull())
    return whole.groupBy("source", "kind", "target").agg(F.min("ord").alias("ord"))


def _graph(spark: SparkSession, d: str, table: str, build) -> DataFrame:
    ship_package(spark)
    store = published(spark, [f"{d}/{table}.parquet"], table, lambda: {table: build()}, {table: ["kind"]})
    return store.table(table).withColumn("kind", F.col("kind").cast("string"))


def meta(key: str) -> Column:
    """A metadata value as text; null where the metadata is missing or not readable JSON."""
    return F.try_variant_get(F.try_parse_json("metadata"), f"$.{key}", "string")


def first_named(nodes_: DataFrame, name: str) -> DataFrame:
    """At most one row: the first node with exactly this name."""
    return nodes_.where(F.col("name") == name).orderBy("ord", "id").limit(1)


NODES_SQL = """nodes AS (
  SELECT id, repo, first_ord AS ord, kind, name, file_path, start_line, end_line, exported, content, metadata FROM (
    SELECT *, min(ord) OVER (PARTITION BY id) AS first_ord, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, ord DESC) AS rn
    FROM code_nodes WHERE id IS NOT NULL) WHERE rn = 1)"""
EDGES_SQL = """edges AS (SELECT source, kind, target, min(ord) AS ord FROM code_edges
  WHERE source IS NOT NULL AND target IS NOT NULL AND kind IS NOT NULL GROUP BY source, kind, target)"""
GRAPH_SQL = f"{NODES_SQL}, {EDGES_SQL}"


def meta_sql(key: str) -> str:
    return f"CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{key}') END"
