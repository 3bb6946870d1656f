"""Cycles and order: strongly connected components, topological layers, linearisation.

Components by forward and backward labels. Nodes without an incoming or outgoing step inside the open part
cannot be on a cycle and are trimmed twice; then every open node takes the least label that
reaches it forward and the least that reaches it backward; nodes whose two labels agree form the component of
that label. The rest continues. Each round closes at least the component of the least open node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.session import Stash


_BATCH = 3


def _trim(steps: DataFrame) -> DataFrame:
    """Steps whose two ends both have a step in and a step out."""
    heads = steps.select(F.col("dst").alias("__x")).distinct()
    tails = steps.select(F.col("src").alias("__y")).distinct()
    return steps.join(heads, F.col("src") == F.col("__x"), "left_semi").join(tails, F.col("dst") == F.col("__y"), "left_semi")


def _spread(ids: DataFrame, steps: DataFrame, stash: Stash) -> DataFrame:
    """``id, fore, back``: the least id that reaches a node, and the least it reaches. Both directions travel in one
    join, and every label is also replaced by the label of the node it names: what reaches that node reaches this one.
    So labels jump over ways they have been before, which saves some rounds; in the worst case there are as many as the
    longest shortest way. A round without a change ends the loop."""
    ways = stash.put(steps.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("f")).unionByName(steps.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(False).alias("f"))), "ways")
    labels = stash.put(ids.select("id", F.col("id").alias("fore"), F.col("id").alias("back")), "labels")
    nothing = F.lit(None).cast(dict(labels.dtypes)["fore"])

    def better(now: DataFrame) -> DataFrame:
        told = now.select(F.col("id").alias("a"), "fore", "back")
        named = F.explode(F.array(F.struct(F.col("fore").alias("a"), F.lit(True).alias("f")), F.struct(F.col("back").alias("a"), F.lit(False).alias("f"))))
        jumps = now.select("id", named.alias("j")).where(F.col("j.a") != F.col("id")).select("j.a", F.col("id").alias("b"), "j.f")
        heard = ways.select("a", "b", "f").unionByName(jumps).join(told, "a").select(F.col("b").alias("id"), F.when(F.col("f"), F.col("fore")).alias("f"), F.when(~F.col("f"), F.col("back")).alias("b"))
        own = now.select("id", F.col("fore").alias("f"), F.col("back").alias("b"), "__f0", "__b0")
        whole = own.unionByName(heard.withColumn("__f0", nothing).withColumn("__b0", nothing))
        return whole.groupBy("id").agg(F.min("f").alias("fore"), F.min("b").alias("back"), F.max("__f0").alias("__f0"), F.max("__b0").alias("__b0"))

    changed = 1
    while changed:
        nxt = better(labels.withColumn("__f0", F.col("fore")).withColumn("__b0", F.col("back")))
        seen = Observation()
        moved = ((F.col("fore") != F.col("__f0")) | (F.col("back") != F.col("__b0"))).cast("int")
        labels = stash.put(nxt.observe(seen, F.coalesce(F.sum(moved), F.lit(0)).alias("n")).select("id", "fore", "back"), "labels")
        changed = seen.get["n"]
    return labels


def strong_components(steps: DataFrame) -> DataFrame:
    """``steps``: src, dst. Returns ``id, component, size`` for components of two or more nodes; the component
    is named by its least id. Self-steps do not count."""
    stash = Stash(steps.sparkSession, "components")
    open_ = stash.put(steps.where((F.col("src") != F.col("dst")) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct(), "open")
    n, done, rounds = open_.count(), None, 0
    while n:
        seen = Observation()
        open_ = stash.put(_trim(_trim(open_)).observe(seen, F.count("*").alias("n")), "open")
        n = seen.get["n"]
        if not n:
            break
        ids = open_.select(F.col("src").alias("id")).union(open_.select("dst")).distinct()
        both = stash.put(_spread(ids, open_, stash).select("id", F.col("fore").alias("label"), F.col("back").alias("__b"), (F.col("fore") == F.col("back")).alias("closed")), "both")
        rounds += 1
        found = stash.put(both.where("closed").select("id", F.col("label").alias("component")), f"found-{rounds}")
        done = found if done is None else done.unionByName(found)
        # Steps between different forward or backward labels lie inside no component.
        a = both.select(F.col("id").alias("src"), F.col("label").alias("__f1"), F.col("__b").alias("__b1"), F.col("closed").alias("__c1"))
        b = both.select(F.col("id").alias("dst"), F.col("label").alias("__f2"), F.col("__b").alias("__b2"))
        seen = Observation()
        rest = open_.join(a, "src").join(b, "dst").where(~F.col("__c1") & (F.col("__f1") == F.col("__f2")) & (F.col("__b1") == F.col("__b2"))).select("src", "dst")
        open_ = stash.put(rest.observe(seen, F.count("*").alias("n")), "open")
        n = seen.get["n"]
    if done is None:
        return steps.where(F.lit(False)).select(F.col("src").alias("id"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size"))
    sizes = done.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    return done.join(sizes, "component").select("id", "component", "size")


def cycle_count(components: DataFrame) -> DataFrame:
    return components.agg(F.countDistinct("component").alias("n"))


def layers(steps: DataFrame) -> DataFrame:
    """``id, layer``: topological layer by peeling nodes without open predecessors; nodes on or behind a cycle
    have a null layer. Several layers are peeled between two writes."""
    stash = Stash(steps.sparkSession, "layers")
    steps = stash.put(steps.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct(), "steps")
    state = steps.select(F.col("src").alias("id")).union(steps.select("dst")).distinct().select("id", F.lit(None).cast("int").alias("layer"))
    state, k, open_ = stash.put(state, "state"), 0, -1
    while True:
        for _ in range(_BATCH):
            waiting = state.where(F.col("layer").isNull()).select(F.col("id").alias("src"))
            blocked = steps.join(waiting, "src", "left_semi").select(F.col("dst").alias("__x")).distinct()
            free = F.col("layer").isNull() & F.col("__x").isNull()
            state = state.join(blocked, F.col("id") == F.col("__x"), "left").select("id", F.when(free, F.lit(k)).otherwise(F.col("layer")).alias("layer"))
            k += 1
        seen = Observation()
        state = stash.put(state.observe(seen, F.coalesce(F.sum(F.col("layer").isNull().cast("long")), F.lit(0)).alias("n")), "state")
        if seen.get["n"] in (0, open_):
            return state
        open_ = seen.get["n"]


# -- small graphs of the driver: phases and class linearisation


def validate_phases(phases: dict[str, list[str]]) -> list[str]:
    """Problems of a phase graph: unknown dependencies and one cycle, as text."""
    out = [f"{p} needs unknown phase {d}" for p, ds in phases.items() for d in ds if d not in phases]
    colour: dict[str, int] = {}

    def visit(p: str, trail: list[str]) -> list[str] | None:
        colour[p] = 1
        for d in phases.get(p, []):
            if colour.get(d) == 1:
                return [*trail[trail.index(d) if d in trail else 0 :], d]
            if d in phases and d not in colour and (c := visit(d, [*trail, d])):
                return c
        colour[p] = 2
        return None

    for p in phases:
        if p not in colour and (c := visit(p, [p])):
            out.append("cycle: " + " -> ".join(c))
            break
    return out


def phase_order(phases: dict[str, list[str]]) -> list[str]:
    """Dependencies first; among free phases the order of declaration."""
    waiting = {p: {d for d in ds if d in phases} for p, ds in phases.items()}
    out: list[str] = []
    while waiting:
        free = [p for p, ds in waiting.items() if not ds]
        if not free:
            raise ValueError("; ".join(validate_phases(phases)))
        for p in free:
            out.append(p)
            del waiting[p]
        for ds in waiting.values():
            ds.difference_update(free)
    return out


def linearise(cls: str, bases: dict[str, list[str]], how: str = "depth-first") -> list[str]:
    """Method resolution order: 'depth-first' (first visit wins, also for 'mixin'), 'c3', or 'none'."""
    if how == "none":
        return [cls]
    if how != "c3":
        out: list[str] = []

        def visit(c: str) -> None:
            if c not in out:
                out.append(c)
                for b in reversed(bases.get(c, [])) if how == "mixin" else bases.get(c, []):
                    visit(b)

        visit(cls)
        return out

    def merge(c: str, above: frozenset[str]) -> list[str]:
        if c in above:
            return []
        lists = [merge(b, above | {c}) for b in bases.get(c, [])] + [list(bases.get(c, []))]
        out = [c]
        while lists := [x for x in lists if x]:
            head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), lists[0][0])
            out.append(head)
            lists = [[y for y in x if y != head] for x in lists]
        return out

    return merge(cls, frozenset())
