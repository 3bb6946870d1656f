"""References to keys that do not exist, from signed counts per key, kept up to date by deltas.

Every change is a delta on a key: a reference adds or takes away one, a node row adds existence at its time, a removal
takes it away at its time, and withdrawing any of these rows is the same delta with the other sign. The state holds
the signed count of each (key, what, time); what sums to zero is gone. It merges with deltas by sums alone, so a
``Ledger`` never reads history again. A key with positive references and zero existence is an orphan; a key exists if
a node row is left that is later than every removal left, or no removal is left.

Defined cases. Null references and null ids are no keys. Repeated rows count as often as they occur, which
changes counts but never whether a key is an orphan. A node whose latest ``indexed_at`` is null is not later
than any removal. Rows whose time is null are reported under a null period. Empty tables give empty reports.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import shared_dir
from weftgraph.sources.folder import Versions

STATE = ["key", "what", "at", "n"]
_NTZ = "timestamp_ntz"


def references(df: DataFrame, table: str, columns: list[str], time: str = "indexed_at") -> DataFrame:
    """``table_name, ref_column, ord, key, at``: one row per non-null reference, in one scan."""
    each = F.array(*[F.struct(F.lit(c).alias("ref_column"), F.col(c).alias("key")) for c in columns])
    return df.select(F.lit(table).alias("table_name"), "ord", F.col(time).alias("at"), F.explode(each).alias("r")).select("table_name", "r.ref_column", "ord", "r.key", "at").where(F.col("key").isNotNull())


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    return _delta(refs, "key", "ref", F.lit(None), sign)


def node_deltas(nodes: DataFrame, sign: int = 1) -> DataFrame:
    return _delta(nodes.where(F.col("id").isNotNull()), "id", "node", F.col("indexed_at"), sign)


def removal_deltas(removals: DataFrame, sign: int = 1) -> DataFrame:
    return _delta(removals.where(F.col("node_id").isNotNull()), "node_id", "removal", F.col("removed_at"), sign)


def _delta(df: DataFrame, key: str, what: str, at, sign: int) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.lit(what).alias("what"), at.cast(_NTZ).alias("at"), F.lit(sign).cast("long").alias("n"))


def merge_state(*parts: DataFrame) -> DataFrame:
    """State after merging any mix of states and deltas; a hot key arrives as one partial row per task."""
    whole = parts[0].select(*STATE)
    for p in parts[1:]:
        whole = whole.unionByName(p.select(*STATE))
    return whole.groupBy("key", "what", "at").agg(F.sum("n").alias("n")).where(F.col("n") != 0).select(*STATE)


def with_existence(state: DataFrame) -> DataFrame:
    """``key, refs, existence``: 1 where the key names a live node, else 0."""
    left = F.col("n") > 0
    node, removal = left & (F.col("what") == "node"), left & (F.col("what") == "removal")
    per_key = state.groupBy("key").agg(
        F.coalesce(F.sum(F.when(F.col("what") == "ref", F.col("n"))), F.lit(0)).alias("refs"), F.max(node.cast("int")).alias("nodes"), F.max(removal.cast("int")).alias("gone"), F.max(F.when(node, F.col("at"))).alias("i"), F.max(F.when(removal, F.col("at"))).alias("r")
    )
    live = (F.col("nodes") == 1) & ((F.col("gone") == 0) | F.coalesce(F.col("i") > F.col("r"), F.lit(False)))
    return per_key.select("key", "refs", F.when(live, 1).otherwise(0).alias("existence"))


class Ledger(Versions):
    """The stored state on the shared file system, one version per applied batch of deltas."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        super().__init__(spark, root or f"{shared_dir(spark)}/weft-orphans-{uuid.uuid4().hex[:10]}")

    def apply(self, *deltas: DataFrame) -> DataFrame:
        """Merges the deltas into the stored state, publishes and returns it. Where a batch fails, the state before
        it stays the current one."""
        known = [self.table("state")] if self.current() else []
        self.save({"state": merge_state(*known, *deltas)})
        return self.table("state")


def orphan_keys(state: DataFrame) -> DataFrame:
    return with_existence(state).where((F.col("refs") > 0) & (F.col("existence") == 0)).select("key", "refs")


def orphan_references(refs: DataFrame, state: DataFrame) -> DataFrame:
    """The referring rows whose key is an orphan. The orphan side is one row per key; where it is small the
    planner broadcasts it, else the skew-aware join splits a hot key on the reference side."""
    return refs.join(orphan_keys(state).select("key"), "key", "left_semi").select("table_name", "ref_column", "ord", "key", "at")


def orphan_report(refs: DataFrame, state: DataFrame) -> DataFrame:
    """``table_name, ref_column, month, n_refs, n_orphans``: all references and orphans per table and month."""
    hit = F.col("o.key").isNotNull()
    slim = refs.groupBy("table_name", "ref_column", F.date_format("at", "yyyy-MM").alias("month"), "key").agg(F.count("*").alias("n"))
    joined = slim.alias("r").join(orphan_keys(state).select("key").alias("o"), F.col("r.key") == F.col("o.key"), "left")
    return joined.groupBy("table_name", "ref_column", "month").agg(F.sum("n").alias("n_refs"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_orphans"))
