"""Readers of the input tables and the two rules every query shares: current rows and live nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import ship_package


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recency() -> Column:
    """Order of versions of an id: the largest ``indexed_at`` (null is oldest), then the largest ``ord``."""
    return F.struct("indexed_at", "ord")


def current(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per non-null id: ``columns`` of its current version.

    A partial ``max`` per task keeps an id with very many versions from meeting in one task.
    Callers pass slim columns; texts are judged before this step and only the verdict travels.
    """
    best = F.max(F.struct(F.col("indexed_at"), F.col("ord"), *[F.col(c) for c in columns if c not in ("indexed_at", "ord", "id")])).alias("v")
    return df.where(F.col("id").isNotNull()).groupBy("id").agg(best).select("id", *[F.col(f"v.{c}").alias(c) for c in columns if c != "id"])


def live_ids(nodes: DataFrame, removals: DataFrame) -> DataFrame:
    """Ids with a row in ``nodes`` and no removal at or after their latest ``indexed_at``."""
    seen = nodes.where(F.col("id").isNotNull()).select("id", "indexed_at", F.lit(None).cast("timestamp_ntz").alias("removed_at"), F.lit(1).alias("here"), F.lit(0).alias("gone"))
    taken = removals.where(F.col("node_id").isNotNull()).select(F.col("node_id").alias("id"), F.lit(None).cast("timestamp_ntz").alias("indexed_at"), "removed_at", F.lit(0).alias("here"), F.lit(1).alias("gone"))
    state = seen.unionByName(taken).groupBy("id").agg(F.max("here").alias("here"), F.max("gone").alias("gone"), F.max("indexed_at").alias("i"), F.max("removed_at").alias("r"))
    return state.where((F.col("here") == 1) & ((F.col("gone") == 0) | (F.col("i") > F.col("r")))).select("id")
