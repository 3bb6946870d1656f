"""Reachability and paths: frontier joins, one distributed round per hop.

``reach`` serves every bounded or unbounded closure. Seeds may carry key columns, so many closures run as one
multi-source job; visited pairs are ruled out by an anti-join and every round is written to the shared folder,
which keeps plans short and survives lost executors. Null seeds are dropped, repeated seeds and steps taken
once, seeds that start no step are still part of their closure at depth 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.session import Stash


def steps_of(edges: DataFrame, kinds: list[str] | None = None, direction: str = "out") -> DataFrame:
    """``src, dst``: one step per edge and allowed direction ('out', 'in' or 'both'). Edges of several kinds may give
    a step several times; whoever walks steps takes nodes once."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    out = e.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = e.select(F.col("target").alias("src"), F.col("source").alias("dst"))
    chosen = {"out": out, "in": back}.get(direction)
    return out.union(back) if chosen is None else chosen


def reach(seeds: DataFrame, steps: DataFrame, hops: int | None, keys: list[str] | None = None, alive: DataFrame | None = None) -> DataFrame:
    """``*keys, id, depth``: all nodes within ``hops`` steps of a seed, with the least depth.

    ``alive`` (column id) limits the nodes that are entered."""
    stash = Stash(seeds.sparkSession, "reach")
    keys = keys or []
    steps = steps.select("src", "dst")
    seen = Observation()
    level = seeds.where(F.col("id").isNotNull()).select(*keys, "id").distinct()
    level = stash.put(level.observe(seen, F.count("*").alias("n")), "level-0")
    levels, depth = [level], 0
    while seen.get["n"] and (hops is None or depth < hops):
        depth += 1
        nxt = level.join(steps, F.col("id") == F.col("src")).select(*keys, F.col("dst").alias("id")).distinct()
        if alive is not None:
            nxt = nxt.join(alive.select("id"), "id", "left_semi")
        visited = reduce(DataFrame.unionByName, levels)
        nxt = nxt.join(visited, [*keys, "id"], "left_anti").select(*keys, "id")
        seen = Observation()
        level = stash.put(nxt.observe(seen, F.count("*").alias("n")), f"level-{depth}")
        levels.append(level)
    return reduce(DataFrame.unionByName, [x.withColumn("depth", F.lit(i)) for i, x in enumerate(levels)])


def closure_sizes(seeds: DataFrame, steps: DataFrame, hops: int, alive: DataFrame | None = None) -> DataFrame:
    """``id, n``: for every seed the number of other nodes within ``hops`` steps."""
    pairs = reach(seeds.select(F.col("id").alias("origin"), "id"), steps, hops, ["origin"], alive)
    return pairs.groupBy(F.col("origin").alias("id")).agg((F.count("*") - 1).alias("n"))


def closure_sizes_sketched(seeds: DataFrame, steps: DataFrame, hops: int, lg_k: int = 12) -> DataFrame:
    """``id, n``: an estimate of ``closure_sizes`` for graphs whose exact pairs would not fit anywhere.

    Every node keeps a sketch of the nodes it reaches; a round unites the sketches along the steps, so the work
    per hop is one pass over the steps, whatever the closures hold. The relative error is about 1.04 / sqrt(2^lg_k),
    1.6 % at the default; callers choose this form explicitly."""
    stash = Stash(seeds.sparkSession, "sketches")
    steps = stash.put(steps.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct(), "steps")
    ids = steps.select(F.col("src").alias("id")).union(steps.select("dst")).union(seeds.select("id").where(F.col("id").isNotNull()))
    have = stash.put(ids.groupBy("id").agg(F.hll_sketch_agg("id", lg_k).alias("sk")), "sketch")
    for _ in range(hops):
        sent = steps.join(have.select(F.col("id").alias("dst"), "sk"), "dst").select(F.col("src").alias("id"), "sk")
        have = stash.put(sent.unionByName(have).groupBy("id").agg(F.hll_union_agg("sk").alias("sk")), "sketch")
    return have.join(seeds.select("id").distinct(), "id", "left_semi").select("id", F.greatest(F.hll_sketch_estimate("sk") - 1, F.lit(0)).alias("n"))


def shortest_path(start: DataFrame, goal: DataFrame, steps: DataFrame, hops: int | None = None) -> DataFrame:
    """``length, path`` of one shortest path between two single-row frames (column id); no row if there is none.

    Each round keeps one path per newly reached node (the least, for a stable result) and stops at the goal.
    Start and goal being the same node counts as no path; callers that want 0 handle it themselves."""
    stash = Stash(start.sparkSession, "path")
    steps = stash.put(steps.select("src", "dst"), "steps")
    goal = stash.put(goal.select(F.col("id").alias("goal")), "goal")
    seen = Observation()
    level = stash.put(start.select("id", F.array("id").alias("path")).observe(seen, F.count("*").alias("n")), "level-0")
    levels, depth = [level.select("id")], 0
    while seen.get["n"] and (hops is None or depth < hops):
        depth += 1
        nxt = level.join(steps, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("path"))
        nxt = nxt.join(reduce(DataFrame.unionByName, levels), "id", "left_anti").select("id", F.concat("path", F.array("id")).alias("path"))
        seen = Observation()
        level = stash.put(nxt.observe(seen, F.count("*").alias("n")), f"level-{depth}")
        hit = level.join(goal, F.col("id") == F.col("goal")).select(F.lit(depth).alias("length"), "path")
        if not hit.isEmpty():
            return hit
        levels.append(level.select("id"))
    return level.where(F.lit(False)).select(F.lit(0).alias("length"), "path")


def all_paths(start: DataFrame, goal: DataFrame, edges: DataFrame, hops: int = 5, limit: int = 10) -> DataFrame:
    """``n, path, last_kind``: simple directed paths over any kind, shorter first, at most ``limit``.

    Every round extends only the prefixes that can still arrive: nodes within the remaining distance of the
    goal, from a reverse closure of the goal."""
    e = edges.select("source", "target", "kind", "ord")
    near = reach(goal.select("id"), steps_of(edges, direction="in"), hops).select(F.col("id").alias("__n"), F.col("depth").alias("__left"))
    stash = Stash(start.sparkSession, "paths")
    e = stash.put(e.join(near, F.col("target") == F.col("__n")), "edges")
    goal = stash.put(goal.select(F.col("id").alias("goal")), "goal")
    front = stash.put(start.select(F.col("id").alias("at"), F.array("id").alias("path"), F.array().cast("array<bigint>").alias("order")), "front-0")
    found = []
    for h in range(1, hops + 1):
        nxt = front.join(e, F.col("at") == F.col("source")).where(~F.array_contains("path", F.col("target")) & (F.col("__left") <= hops - h))
        nxt = nxt.select(F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path"), F.concat("order", F.array("ord")).alias("order"), "kind")
        nxt = stash.put(nxt, f"front-{h}")
        found.append(nxt.join(goal, F.col("at") == F.col("goal")).select(F.lit(h).alias("n"), "path", "order", F.col("kind").alias("last_kind")))
        front = nxt.join(goal, F.col("at") == F.col("goal"), "left_anti").select("at", "path", "order")
    return reduce(DataFrame.unionByName, found).orderBy("n", "order").limit(limit).select("n", "path", "last_kind")


def risk(size: str, high: int, medium: int, at_least: bool = False):
    """HIGH above ``high``, MEDIUM above ``medium`` (from ``medium`` on, if ``at_least``), else LOW."""
    n = F.col(size)
    return F.when(n > high, "HIGH").when((n >= medium) if at_least else (n > medium), "MEDIUM").otherwise("LOW")
