"""Parent-child links to full hierarchies, by heavy-path decomposition.

1. Doubling. Every node keeps its ancestor 2^k links up and the number of its descendants nearer than 2^k.
   One round doubles both: descendants between 2^k and 2^(k+1) belong to exactly one node 2^k below. Depth,
   root and subtree size take log2(depth) rounds. When a round resolves nobody although some are open, the
   open ones are on a cycle or below one: a tree with a node deeper than 2^(k+1) also has one in between.
2. Chains. The child with the largest subtree continues its parent's chain (ties: the larger id). Doubling
   inside chains gives head and position.
3. Chain tree. A path to the root crosses at most log2(n) light links, so the tree of chains is resolved level
   by level; a chain keeps its segments (chain, last position) up to the root.

A node's path is its segments; its descendants are the nodes further down its chain, and all nodes with a
segment that leaves that chain at or below it. Pairs of ancestor and descendant are never stored.

Defined cases. Links with a null end are dropped, repeated links taken once, a self-link is a cycle. A child
with several parents keeps the one of the smallest ``rank`` (links may have that column), then the smallest id. Ids are compared byte by byte. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.session import Stash

CYCLE = "(cycle)"


def clean_links(links: DataFrame) -> DataFrame:
    """``id, parent``: one parent per child."""
    rank = F.col("rank") if "rank" in links.columns else F.lit(0)
    return links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy(F.col("child").alias("id")).agg(F.min(F.struct(rank.alias("rank"), F.col("parent"))).getField("parent").alias("parent"))


def _climb(nodes: DataFrame, stash: Stash, slot: str, sizes: bool, between: str | None = None) -> DataFrame:
    """``nodes``: id, parent (null at a root). Returns id, parent, root, depth and, on request, size, or the ids from
    the root on, joined with ``between``, as text; root and depth stay null for a node that never reaches a root."""
    at_root = F.col("parent").isNull()
    seen = Observation()
    first = nodes.select("id", "parent", F.col("parent").alias("anc"), F.when(at_root, F.col("id")).alias("root"), F.when(at_root, F.lit(0).cast("long")).alias("depth"), F.lit(1).cast("long").alias("size"), F.col("id").alias("text") if between else F.lit(None).cast("string").alias("text"))
    state = stash.put(first.observe(seen, F.count("anc").alias("open")), slot)
    open_ = seen.get["open"]
    step = 1
    while open_:
        up = state.select(F.col("id").alias("__id"), F.col("anc").alias("__anc"), F.col("root").alias("__root"), F.col("depth").alias("__depth"), F.col("text").alias("__text"))
        nxt = state.join(up, F.col("anc") == F.col("__id"), "left")
        if sizes:
            below = state.where(F.col("anc").isNotNull()).groupBy(F.col("anc").alias("__of")).agg(F.sum("size").alias("__more"))
            nxt = nxt.join(below, F.col("id") == F.col("__of"), "left").withColumn("size", F.col("size") + F.coalesce("__more", F.lit(0)))
        found = F.col("anc").isNotNull() & F.col("__depth").isNotNull()
        nxt = nxt.select(
            "id", "parent",
            F.when(F.col("anc").isNotNull() & F.col("__depth").isNull(), F.col("__anc")).alias("anc"),
            F.when(found, F.col("__root")).otherwise(F.col("root")).alias("root"),
            F.when(found, F.col("__depth") + step).otherwise(F.col("depth")).alias("depth"),
            "size",
            F.when(F.col("anc").isNotNull(), F.concat_ws(between or "", "__text", "text")).otherwise(F.col("text")).alias("text"),
        )
        seen = Observation()
        state = stash.put(nxt.observe(seen, F.count("anc").alias("open")), slot)
        step *= 2
        left = seen.get["open"]
        if left == open_:
            break
        open_ = left
    return state.select("id", "parent", "root", "depth", *(["size"] if sizes else []), *(["text"] if between else []))


def hierarchy(links: DataFrame, between: str | None = None) -> DataFrame:
    """``links``: child, parent and perhaps rank. One row per id on either side of a link:

    ``id, parent, root_id, depth, size, chain, pos, segments``; size counts the node itself and its
    descendants; chain is the id of the chain's first node and pos the place on it; segments are the
    (chain, pos) at which the path leaves each chain above, from the root down. A node on a cycle, or
    whose ancestors lead into one, has root_id '(cycle)', depth -1 and nulls in the rest. With ``between`` each row
    has also its piece: the ids of its chain down to it, joined with that text (see ``paths``).
    """
    stash = Stash(links.sparkSession, "hierarchy")
    parents = stash.put(clean_links(links), "parents")
    ids = parents.select("id").union(parents.select("parent")).distinct()
    tree = _climb(ids.join(parents, "id", "left"), stash, "tree", sizes=True)

    heavy = tree.where(F.col("parent").isNotNull() & F.col("depth").isNotNull()).groupBy(F.col("parent").alias("__p")).agg(F.max(F.struct("size", "id")).getField("id").alias("__heavy"))
    on_chain = tree.where(F.col("depth").isNotNull()).join(heavy, F.col("id") == F.col("__heavy"), "left").select("id", F.when(F.col("__heavy").isNotNull(), F.col("parent")).alias("parent"))
    chains = _climb(on_chain, stash, "chain", sizes=False, between=between).select("id", F.col("root").alias("chain"), F.col("depth").alias("pos"), *([F.col("text").alias("piece")] if between else []))
    nodes = stash.put(tree.join(chains, "id", "left"), "nodes")

    heads = nodes.where(F.col("id") == F.col("chain")).select(F.col("id").alias("head"), F.col("parent").alias("__p"))
    above = nodes.select(F.col("id").alias("__q"), F.col("chain").alias("up"), F.col("pos").alias("up_pos"))
    seen = Observation()
    heads = stash.put(heads.join(above, F.col("__p") == F.col("__q"), "left").select("head", "up", "up_pos"), "heads")
    level = heads.where(F.col("up").isNull()).select("head", F.lit(0).cast("long").alias("base"), F.col("head").alias("root_id"), F.expr("cast(array() as array<struct<chain:string,pos:bigint>>)").alias("segments"))
    level = stash.put(level.observe(seen, F.count("*").alias("n")), "level-0")
    done, n = level, 1
    while seen.get["n"]:
        seen = Observation()
        over = level.select(F.col("head").alias("__h"), F.col("base").alias("__b"), F.col("root_id"), F.col("segments").alias("__s"))
        nxt = heads.where(F.col("up").isNotNull()).join(over, F.col("up") == F.col("__h")).select("head", (F.col("__b") + F.col("up_pos") + 1).alias("base"), "root_id", F.concat("__s", F.array(F.struct(F.col("up").alias("chain"), F.col("up_pos").alias("pos")))).alias("segments"))
        level = stash.put(nxt.observe(seen, F.count("*").alias("n")), f"level-{n}")
        done, n = done.unionByName(level), n + 1
    out = nodes.drop("root", "depth").join(done, F.col("chain") == F.col("head"), "left")
    lost = F.col("chain").isNull()
    return out.select(
        "id", "parent",
        F.when(lost, F.lit(CYCLE)).otherwise(F.col("root_id")).alias("root_id"),
        F.when(lost, F.lit(-1).cast("long")).otherwise(F.col("base") + F.col("pos")).alias("depth"),
        F.when(~lost, F.col("size")).alias("size"), "chain", "pos", "segments", *(["piece"] if between else []),
    )


def paths(tree: DataFrame, between: str = " > ") -> DataFrame:
    """``id, path``: ids from the root to the node. ``tree`` comes from ``hierarchy`` with the same ``between``. A path
    is the piece of each node at which it leaves a chain, and the node's own piece: at most log2(n) + 1 texts, found
    by (chain, position); no chain is gathered and no row holds more than its own path."""
    nodes = tree.where(F.col("chain").isNotNull())
    pieces = nodes.select(F.col("chain").alias("__c"), F.col("pos").alias("__p"), F.col("piece").alias("__piece"))
    parts = nodes.select("id", F.posexplode("segments").alias("__k", "__seg")).join(pieces, (F.col("__seg.chain") == F.col("__c")) & (F.col("__seg.pos") == F.col("__p"))).select("id", "__k", "__piece")
    above = parts.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", "__piece"))), lambda x: x["__piece"]).alias("__above"))
    return nodes.select("id", "piece").join(above, "id", "left").select("id", F.concat_ws(between, "__above", "piece").alias("path"))


def descendants(tree: DataFrame, of: DataFrame) -> DataFrame:
    """``ancestor, id`` for every id in ``of`` (column id): an equi-join on chains with a position bound."""
    wanted = tree.join(of.select("id").distinct(), "id", "left_semi").where(F.col("chain").isNotNull()).select(F.col("id").alias("ancestor"), F.col("chain").alias("__c"), F.col("pos").alias("__pos"))
    places = tree.where(F.col("chain").isNotNull()).select("id", F.explode(F.concat("segments", F.array(F.struct("chain", "pos")))).alias("__seg"))
    hit = places.join(wanted, (F.col("__seg.chain") == F.col("__c")) & (F.col("__seg.pos") >= F.col("__pos")))
    return hit.where(F.col("id") != F.col("ancestor")).select("ancestor", "id")
