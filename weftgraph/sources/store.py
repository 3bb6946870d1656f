"""Versioned graph storage and sinks.

Graphs, vectors and indexes are versions of parquet tables on the shared file system (``sources.folder``): nodes and
edges are partitioned by kind. Upserts and deletes are anti-joins and unions into a new version.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.folder import Folder, Versions

SCHEMA_VERSION = 1


class GraphStore(Versions):
    TABLES = ["nodes", "edges"]

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        super().__init__(spark, root, keep)

    def stage_graph(self, nodes: DataFrame, edges: DataFrame) -> str:
        return self.stage({"nodes": nodes, "edges": edges}, {"nodes": ["kind"], "edges": ["kind"]})

    def publish_graph(self, version: str, **meta) -> dict:
        """Makes a staged version current if its tables are complete; drops versions beyond ``keep``."""
        return self.publish(version, self.TABLES, schemaVersion=SCHEMA_VERSION, **meta)

    def trust(self) -> tuple[str, list[str]]:
        """trusted, stale, corrupt, legacy or missing, with reasons."""
        record = self.current()
        if record is None:
            return ("corrupt", ["pointer-unreadable"]) if self.folder.names(self.RECORD) else ("legacy", ["no-pointer"]) if self.versions() else ("missing", ["no-index"])
        if record.get("schemaVersion", 0) > SCHEMA_VERSION:
            return "corrupt", ["newer-schema"]
        if not self.complete(record["version"], self.TABLES):
            return "corrupt", ["missing-table"]
        return ("stale", ["newer-version-staged"]) if self.versions()[-1] > record["version"] else ("trusted", [])

    def read(self) -> tuple[DataFrame, DataFrame]:
        return self.table("nodes"), self.table("edges")

    def write(self, nodes: DataFrame, edges: DataFrame, **meta) -> dict:
        return self.publish_graph(self.stage_graph(nodes, edges), **meta)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes the nodes of files (column file_path, relative or absolute) and every edge that touches one."""
    wanted = files.select(F.col("file_path").alias("__f"), F.element_at(F.split("file_path", "/"), -1).alias("__b"))
    based = nodes.withColumn("__b", F.element_at(F.split("file_path", "/"), -1))
    gone = based.join(wanted, "__b").where((F.col("file_path") == F.col("__f")) | F.col("__f").endswith(F.concat(F.lit("/"), F.col("file_path")))).select("id").distinct()
    kept = nodes.join(gone, "id", "left_anti")
    for end in ("source", "target"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return kept, edges


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes: what a table with references can hold."""
    ids = nodes.select("id")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges


class VectorStore(Versions):
    """Stored vectors by id (``id, file_path, embedding`` and more): full replacement, upsert and delete by file, each
    a new version."""

    @property
    def vectors(self) -> DataFrame:
        return self.table("vectors")

    def build(self, rows: DataFrame) -> VectorStore:
        self.save({"vectors": rows})
        return self

    def upsert(self, rows: DataFrame) -> VectorStore:
        return self.build(upsert(self.vectors, rows, ["id"]))

    def delete_files(self, files: DataFrame) -> VectorStore:
        """``files``: column file_path."""
        return self.build(self.vectors.join(files.select("file_path").distinct(), "file_path", "left_anti"))


# -- sinks


def to_csv(df: DataFrame, path: str) -> None:
    """CSV with quoted fields where needed and doubled quotes."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def to_json(df: DataFrame, path: str) -> None:
    """One compact object per line, without null keys."""
    df.write.mode("overwrite").json(path)


def compact_json(*columns: str) -> F.Column:
    return F.to_json(F.struct(*columns))


SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result as JSON text (column ``result``) per row of findings (rule, level, message, file, line)."""
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), F.col("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def write_sarif(findings: DataFrame, root: str, name: str, tool: str, version: str = "0.1.0", most_rules: int = 10_000) -> None:
    """A SARIF 2.1.0 document ``root/name``. Results are written by the tasks that hold them and the part files are
    joined byte by byte, so no task and no driver holds all findings; only the ids of the rules (refused beyond
    ``most_rules``) come to the driver."""
    folder = Folder(findings.sparkSession, root)
    rules = [r.rule for r in findings.select("rule").distinct().orderBy("rule").limit(most_rules + 1).collect()]
    if len(rules) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    parts = f"_parts-{name}"
    sarif_results(findings).select(F.concat(F.lit(","), "result").alias("value")).write.mode("overwrite").text(folder.at(parts))
    driver = {"name": tool, "version": version, "rules": [{"id": r} for r in rules]}
    head = f'{{"version":"2.1.0","$schema":"{SARIF_SCHEMA}","runs":[{{"tool":{{"driver":{json.dumps(driver)}}},"results":['
    folder.join_parts(parts, name, head, "]}]}", skip=1)
    folder.delete(parts)


class EventLog:
    """Append-only lines of JSON; does nothing unless enabled and never raises."""

    def __init__(self, path: str, enabled: bool = True):
        self.path, self.enabled = path, enabled

    def append(self, **event) -> None:
        if not self.enabled:
            return
        try:
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(json.dumps(event) + "\n")
        except (OSError, TypeError):
            pass

    def tail(self, n: int) -> list[dict]:
        try:
            with open(self.path, encoding="utf-8") as f:
                return [json.loads(x) for x in f.readlines()[-n:]]
        except (OSError, ValueError):
            return []


class QueryCache:
    """Results by key, least recently used out first."""

    def __init__(self, size: int = 128):
        self.size, self.rows, self.hits = size, {}, Counter()

    def get(self, key, make):
        if key in self.rows:
            self.rows[key] = self.rows.pop(key)
            self.hits["hit"] += 1
            return self.rows[key]
        self.hits["miss"] += 1
        self.rows[key] = value = make()
        if len(self.rows) > self.size:
            self.rows.pop(next(iter(self.rows)))
        return value
