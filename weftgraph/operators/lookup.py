"""Lookups over the graph: overview, inspection, pages, grep, symbol resolution, freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import path_intent
from weftgraph.graph import first_named
from weftgraph.operators.reach import reach, risk, shortest_path, steps_of

RELATIONS = [("callers", ["calls"], "in"), ("callees", ["calls"], "out"), ("imports", ["imports"], "out"), ("importedBy", ["imports"], "in"), ("heritage", ["extends", "implements"], "out"), ("members", ["has_member"], "out"), ("cluster", ["belongs_to"], "out")]


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    count = F.count("*").alias("n")
    return nodes.groupBy("kind").agg(count).select(F.lit("node").alias("what"), "kind", "n").unionByName(edges.groupBy("kind").agg(count).select(F.lit("edge").alias("what"), "kind", "n"))


def inspect(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``relation, id, name`` around the first node of that name; imports are outgoing, importedBy incoming."""
    return around(nodes, edges, first_named(nodes, name))


def node_detail(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``relation, id, name`` around the node with this id."""
    return around(nodes, edges, nodes.where(F.col("id") == node))


def around(nodes: DataFrame, edges: DataFrame, one: DataFrame) -> DataFrame:
    me = one.select(F.col("id").alias("me"))
    ends = nodes.select("id", "name")
    parts = []
    for relation, kinds, direction in RELATIONS:
        mine, other = ("target", "source") if direction == "in" else ("source", "target")
        hit = edges.where(F.col("kind").isin(kinds)).join(me, F.col(mine) == F.col("me"), "left_semi").select(F.lit(relation).alias("relation"), F.col(other).alias("id"))
        parts.append(hit)
    return reduce(DataFrame.unionByName, parts).join(ends, "id").select("relation", "id", "name")


def find_path(nodes: DataFrame, edges: DataFrame, start: str, goal: str, hops: int = 8) -> DataFrame:
    """``hops`` of a shortest directed path over the given edges; 0 for the same node."""
    a, b = first_named(nodes, start).select("id"), first_named(nodes, goal).select("id")
    same = a.join(b, "id").select(F.lit(0).alias("hops"))
    return same.unionByName(shortest_path(a, b.join(a, "id", "left_anti"), steps_of(edges), hops).select(F.col("length").alias("hops")))


def blast_radius(nodes: DataFrame, edges: DataFrame, name: str, direction: str, hops: int) -> DataFrame:
    """``n_affected, risk``; the target itself counts. No row if the name is unknown."""
    found = reach(first_named(nodes, name).select("id"), steps_of(edges, direction=direction), hops)
    return found.agg(F.count("*").alias("n_affected")).where(F.col("n_affected") > 0).withColumn("risk", risk("n_affected", 10, 5))


def shared_imports(nodes: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    def targets(name: str) -> DataFrame:
        return edges.join(first_named(nodes, name).select(F.col("id").alias("me")), F.col("source") == F.col("me"), "left_semi").select(F.col("target").alias("id"))

    return targets(a).intersect(targets(b))


def heritage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("id").alias("source"), F.col("name").alias("child")), nodes.select(F.col("id").alias("target"), F.col("name").alias("parent"))
    return edges.join(a, "source").join(b, "target").select("child", "parent", "kind")


def suggestions(nodes: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Names that start with the query's first letter or contain it, in order of arrival."""
    low = F.lower("name")
    hit = nodes.where(low.startswith(query[:1].lower()) | low.contains(query.lower()))
    return hit.groupBy("name").agg(F.min("ord").alias("o")).orderBy("o", "name").limit(limit).select("name")


def file_symbols(nodes: DataFrame, path: str, limit: int = 200, offset: int = 0) -> DataFrame:
    return nodes.where(F.col("file_path").contains(path)).orderBy(F.coalesce("start_line", F.lit(0)), "ord", "id").offset(offset).limit(limit)


def list_exports(nodes: DataFrame, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    hit = nodes.where(F.col("exported"))
    return (hit if kind is None else hit.where(F.col("kind") == kind)).orderBy("ord", "id").offset(offset).limit(limit)


def routes(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("kind") == "route") | ((F.col("kind") == "function") & F.col("file_path").rlike("(?i)route|handler|controller")))


def clusters(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """``id, name, n_members, members``: members in order of arrival, the first ``top`` by name."""
    rank = F.row_number().over(Window.partitionBy("target").orderBy("ord", "source"))
    links = edges.where(F.col("kind") == "belongs_to")
    sizes = links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_members"))
    first = links.withColumn("r", rank).where(F.col("r") <= top).join(nodes.select(F.col("id").alias("source"), F.col("name").alias("member")), "source")
    lists = first.groupBy(F.col("target").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "member"))), lambda x: x["member"]).alias("members"))
    return nodes.where(F.col("kind") == "cluster").select("id", "name").join(sizes, "id", "left").join(lists, "id", "left").fillna(0, ["n_members"])


def flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, n_steps, steps``: flows with the names of their steps in order, from step_of edges (source, target, label);
    a flow has at most the depth it was traced to."""
    at = F.regexp_extract("label", r"(\d+)$", 1).cast("int")
    steps = edges.where(F.col("kind") == "step_of").select(F.col("source").alias("flow"), F.col("target").alias("id"), at.alias("at")).join(nodes.select("id", "name"), "id", "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("name", "id").alias("name")))), lambda x: x["name"])
    return steps.groupBy(F.col("flow").alias("id")).agg(F.count("*").alias("n_steps"), listed.alias("steps"))


def page(nodes: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    return nodes.orderBy("ord", "id").offset(offset).limit(min(limit, 1000))


def grep(files: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """``id, line, text``: lines of stored files that match, without case."""
    lines = files.where((F.col("kind") == "file") & F.col("content").isNotNull() & F.col("content").rlike(f"(?i){pattern}")).select("id", "ord", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    return lines.where(F.col("text").rlike(f"(?i){pattern}")).orderBy("ord", "id", "line").limit(limit).select("id", (F.col("line") + 1).cast("long").alias("line"), "text")


def source_window(files: DataFrame, first: int, last: int, around: int = 20) -> DataFrame:
    """``id, text``: the lines asked for with ``around`` lines on either side."""
    start = max(1, first - around)
    return files.where(F.col("content").isNotNull()).select("id", F.array_join(F.slice(F.split("content", "\n"), start, last + around - start + 1), "\n").alias("text"))


def resolve_symbol(nodes: DataFrame, text: str) -> DataFrame:
    """``id, intent, rank``. ``kind:name@path[:line]`` names one symbol; a bare name is ranked: main sources,
    then unknown places, then the rest, by path, line, kind and id. More than one row is an ambiguity."""
    import re

    m = re.fullmatch(r"(\w+):([^@]+)@(.+?)(?::(\d+))?", text)
    if m:
        hit = nodes.where((F.col("kind") == m[1]) & (F.col("name") == m[2]) & (F.col("file_path") == m[3]))
        if m[4]:
            hit = hit.where(F.col("start_line") == int(m[4]))
    else:
        hit = nodes.where(F.col("name") == text)
    hit = hit.withColumn("intent", path_intent(F.col("file_path")))
    place = F.when(F.col("intent") == "main", 0).when(F.col("intent") == "unknown", 1).otherwise(2)
    return hit.withColumn("rank", F.row_number().over(Window.orderBy(place, "file_path", F.asc_nulls_first("start_line"), "kind", "id"))).select("id", "intent", "rank")


def freshness(repos: DataFrame, now: str, stale_minutes: int = 1440) -> DataFrame:
    age = F.timestamp_diff("MINUTE", F.col("indexed_at").cast("timestamp_ntz"), F.to_timestamp_ntz(F.lit(now)))
    return repos.withColumn("age_minutes", age).withColumn("status", F.when(F.col("indexed_at").isNull(), "UNKNOWN").when(age > stale_minutes, "STALE").otherwise("FRESH"))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, n_nodes, n_edges``; an edge belongs to the repo of its source."""
    n = nodes.groupBy("repo").agg(F.count("*").alias("n_nodes"))
    e = edges.join(nodes.select(F.col("id").alias("source"), "repo"), "source").groupBy(F.col("repo").alias("r")).agg(F.count("*").alias("n_edges"))
    return n.join(e, F.col("repo").eqNullSafe(F.col("r")), "left").select("repo", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def warm_set(edges: DataFrame, n: int) -> DataFrame:
    """The ids with the most outgoing edges: what to keep in a cache."""
    return edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_out")).orderBy(F.desc("n_out"), "id").limit(n)


def point_lookup(nodes: DataFrame, node_id: str) -> DataFrame:
    """One node; the kind in front of the id narrows the scan to that kind."""
    kind = node_id.split(":", 1)[0]
    return nodes.where((F.col("kind") == kind) & (F.col("id") == node_id))


def degree(edges: DataFrame, end: str, kinds: list[str] | None = None, name: str = "n") -> DataFrame:
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    return e.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))
