"""Entry points, call flows, directory clusters and similar names.

Entry scores and clusters are plain plans. A flow trace is sequential by definition (a node entered from one
branch is closed to the others), so the graph part that the chosen entries can reach within the depth limit is
cut out by joins first and each entry is traced in its own group: at most ``branching`` calls per node and
``depth`` nodes per path bound what a group holds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions import text as T
from weftgraph.graph import first_named
from weftgraph.operators.lookup import degree
from weftgraph.operators.reach import reach

#: Beginnings of names that look like entry points.
ENTRY_WORDS = ["main", "handle", "init", "start", "run", "execute", "process", "serve", "listen", "bootstrap"]
CLUSTER_KINDS = ["function", "class", "interface", "method", "struct", "enum", "trait"]
LIBRARY_CLUSTER_KINDS = ["function", "class", "method", "interface", "struct"]


def test_like(path: Column) -> Column:
    return T.path_intent(path).isin("test", "fixture", "bench") | path.contains("__test")


def entry_points(nodes: DataFrame, edges: DataFrame, library: bool = False, least: int = 5) -> DataFrame:
    """``id, score``. The library form knows nine words (no bootstrap) and no handler paths."""
    words = ENTRY_WORDS[:-1] if library else ENTRY_WORDS
    places = ["route", "controller"] if library else ["route", "controller", "handler"]
    p = F.col("file_path")
    n = nodes.where(F.col("kind").isin("function", "method")).join(degree(edges, "source", ["calls"], "n_out"), "id", "left").join(degree(edges, "target", ["calls"], "n_in"), "id", "left")
    at_place = F.lit(False)
    for x in places:
        at_place = at_place | p.contains(x)
    score = (
        F.when(F.col("n_in").isNull() & (F.col("n_out") > 0), 10).otherwise(0)
        + F.when(F.col("exported"), 5).otherwise(0)
        + F.when(F.col("name").rlike("^(" + "|".join(words) + ")"), 3).otherwise(0)
        - F.when(test_like(p), 20).otherwise(0)
        + F.when(at_place, 8).otherwise(0)
    )
    return n.select("id", "ord", "file_path", score.alias("score")).where(F.col("score") >= least)


def trace_flows(nodes: DataFrame, edges: DataFrame, top: int = 20, depth: int = 10, branching: int = 4, most: int = 75, dedup: float | None = None) -> DataFrame:
    """``entry, flow, steps``: paths of at least three nodes from the ``top`` entries to a node that calls nothing
    more; at most ``most`` flows per run, entries in order of score. ``dedup`` drops a flow that shares more
    than that part of its steps with an earlier one of the entry."""
    entries = entry_points(nodes, edges).orderBy(F.desc("score"), "ord", "id").limit(top).select(F.col("id").alias("entry"), F.row_number().over(Window.orderBy(F.desc("score"), "ord", "id")).alias("place"), (~test_like(F.col("file_path"))).alias("strict"))
    targets = nodes.select(F.col("id").alias("target"), test_like(F.col("file_path")).alias("is_test"))
    calls = edges.where(F.col("kind") == "calls").join(targets, "target", "left").select("source", "target", "ord", F.coalesce("is_test", F.lit(False)).alias("is_test"))
    parts = []
    for strict in (True, False):
        e = calls.where(~F.col("is_test")) if strict else calls
        first = e.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("ord", "target"))).where(F.col("r") <= branching)
        seeds = entries.where(F.col("strict") == strict).select(F.col("entry").alias("id"), "entry")
        near = reach(seeds, first.select(F.col("source").alias("src"), F.col("target").alias("dst")), depth, ["entry"]).select("entry", F.col("id").alias("source"))
        parts.append(near.join(first, "source").select("entry", "source", "target", "r"))
    sub = parts[0].unionByName(parts[1]).join(entries.select("entry", "place"), "entry")

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, place = pdf["entry"].iloc[0], int(pdf["place"].iloc[0])
        after: dict[str, list[str]] = {}
        for s, t in pdf.sort_values(["source", "r"])[["source", "target"]].itertuples(index=False):
            after.setdefault(s, []).append(t)
        queue, seen, found = [[entry]], set(), []
        for path in queue:
            if len(path) > depth or len(found) >= most:
                continue
            nxt = after.get(path[-1], [])
            if not nxt:
                if len(path) >= 3:
                    found.append(path)
                continue
            for t in nxt:
                if t not in seen:
                    seen.add(t)
                    queue.append([*path, t])
        if dedup is not None:
            kept: list[tuple[list[str], set]] = []
            for path in found:
                pairs = set(zip(path, path[1:]))
                if not any(len(pairs & k) > dedup * max(1, len(pairs)) for _, k in kept):
                    kept.append((path, pairs))
            found = [p for p, _ in kept]
        return pd.DataFrame({"entry": entry, "place": place, "n": range(len(found)), "steps": pd.Series(found, dtype=object)})

    flows = sub.groupBy("entry").applyInPandas(trace, "entry string, place int, n int, steps array<string>")
    return flows.withColumn("flow", F.row_number().over(Window.orderBy("place", "n"))).where(F.col("flow") <= most).select("entry", "flow", "steps")


def flow_steps(flows: DataFrame) -> DataFrame:
    """Materialised flows: ``source, kind, target, label`` with one step_of edge per step."""
    return flows.select("flow", F.posexplode("steps").alias("i", "target")).select(F.concat(F.lit("flow:"), F.col("flow")).alias("source"), F.lit("step_of").alias("kind"), "target", F.concat(F.lit("step "), F.col("i")).alias("label"))


def directory_clusters(nodes: DataFrame, library: bool = False) -> DataFrame:
    """``directory, n_members``: directories with two or more symbols; the library form knows fewer kinds and
    needs ten symbols overall."""
    hit = nodes.where(F.col("kind").isin(LIBRARY_CLUSTER_KINDS if library else CLUSTER_KINDS)).select(T.dirname(F.col("file_path")).alias("directory"))
    out = hit.groupBy("directory").agg(F.count("*").alias("n_members")).where(F.col("n_members") >= 2)
    if library:
        out = out.crossJoin(hit.agg(F.count("*").alias("__all"))).where(F.col("__all") >= 10).drop("__all")  # one row of totals
    return out


def cluster_edges(nodes: DataFrame) -> DataFrame:
    """Membership: ``source, kind, target`` from a symbol to its directory cluster."""
    hit = nodes.where(F.col("kind").isin(CLUSTER_KINDS)).select(F.col("id").alias("source"), T.dirname(F.col("file_path")).alias("directory"))
    return hit.join(directory_clusters(nodes).select("directory"), "directory", "left_semi").select("source", F.lit("belongs_to").alias("kind"), F.concat(F.lit("cluster:"), F.col("directory")).alias("target"))


def cluster_members(nodes: DataFrame, cluster: str) -> DataFrame:
    return nodes.where(F.col("file_path").startswith(cluster))


def cluster_symbols(nodes: DataFrame, edges: DataFrame, cluster: str, top: int = 5) -> DataFrame:
    """``id, n_in``: the members with the most incoming edges."""
    return cluster_members(nodes, cluster).join(degree(edges, "target", name="n_in"), "id", "left").fillna(0, ["n_in"]).orderBy(F.desc("n_in"), "ord", "id").limit(top).select("id", "n_in")


def cluster_links(nodes: DataFrame, edges: DataFrame, cluster: str) -> DataFrame:
    """``relation, place``: first two path segments on the other end of imports that cross the boundary."""
    side = nodes.select("id", "file_path", F.coalesce(F.col("file_path").startswith(cluster), F.lit(False)).alias("inside"))
    a = side.select(F.col("id").alias("source"), F.col("file_path").alias("sp"), F.col("inside").alias("si"))
    b = side.select(F.col("id").alias("target"), F.col("file_path").alias("tp"), F.col("inside").alias("ti"))
    cross = edges.where(F.col("kind") == "imports").join(a, "source").join(b, "target").where(F.col("si") != F.col("ti"))
    return cross.select(F.when(F.col("si"), "dependency").otherwise("dependent").alias("relation"), T.first_segments(F.when(F.col("si"), F.col("tp")).otherwise(F.col("sp"))).alias("place")).distinct()


def similar_symbols(nodes: DataFrame, edges: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """``id, similarity, reasons``: by edit distance of the name and same kind; one target row meets all nodes."""
    target = first_named(nodes, name).select(F.col("id").alias("__id"), F.col("kind").alias("__kind"))
    group = edges.where(F.col("kind") == "belongs_to").groupBy(F.col("source").alias("id")).agg(F.min("target").alias("module"))
    mine = group.join(target.select(F.col("__id").alias("id")), "id").select(F.col("module").alias("__module"))
    others = nodes.join(F.broadcast(target), F.col("id") != F.col("__id")).join(group, "id", "left")  # target: one row
    others = others.join(F.broadcast(mine), F.lit(True), "left")
    close = T.name_similarity(F.col("name"), F.lit(name))
    same = F.col("kind") == F.col("__kind")
    reasons = F.array_compact(F.array(F.when(close >= 0.6, "similar name"), F.when(same, "same kind"), F.when(F.col("module") == F.col("__module"), "same module")))
    return others.select("id", "ord", F.round(0.5 * close + F.when(same, 0.25).otherwise(0.0), 6).alias("similarity"), F.array_join(reasons, ", ").alias("reasons")).orderBy(F.desc("similarity"), "ord", "id").limit(max(1, min(limit, 50))).drop("ord")
