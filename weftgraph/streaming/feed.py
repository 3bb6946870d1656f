"""Change feed on Structured Streaming.

The native file source reports new files only, so a feed works on manifests: every micro-batch of changed paths
names what to look at, and the difference between the stored and the current manifest says what was added,
changed or deleted. A patch removes the affected files and everything that depends on their symbols by name,
reads those files again, resolves their names against the stored symbols of the others and publishes a new version,
so cross-file edges are rebuilt and not lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.ingest import analyze
from weftgraph.session import shared_dir
from weftgraph.sources.store import GraphStore, delete_files


def debounce(changes: DataFrame, gap: str = "300 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """``repo, began, ended, paths``: changes (repo, at, path) of a repo that follow each other within ``gap`` form one
    batch. Every repo has its own window, so a steady feed of many repos grows no common one."""
    late = changes.withWatermark("at", delay) if changes.isStreaming else changes
    return late.groupBy("repo", F.session_window("at", gap).alias("w")).agg(F.collect_set("path").alias("paths")).select("repo", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "paths")


def affected_files(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed files and the files with an edge into or out of their symbols (column file_path)."""
    paths = nodes.select("id", "file_path")
    mine = paths.join(changed.select("file_path").distinct(), "file_path", "left_semi").select("id")
    out = edges.join(mine.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    into = edges.join(mine.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    return paths.join(out.union(into).distinct(), "id", "left_semi").select("file_path").union(changed.select("file_path")).distinct()


def patch(store: GraphStore, files: DataFrame, changed: DataFrame) -> dict:
    """Brings the store up to date with ``files`` (repo, path, language, text: the present tree) after changes to
    the paths in ``changed`` (file_path), deleted ones included. Only changed files and those that depend on them are
    read; of the others the stored symbols take part in resolving names. Returns the published record."""
    nodes, edges = store.read()
    touched = affected_files(nodes, edges, changed)
    kept_nodes, kept_edges = delete_files(nodes, edges, touched)
    again = files.join(touched.withColumnRenamed("file_path", "path"), "path", "left_semi")
    new_nodes, new_edges = analyze(again, known=kept_nodes, tree=files.select("repo", "path"))
    return store.write(kept_nodes.unionByName(new_nodes, allowMissingColumns=True), kept_edges.unionByName(new_edges, allowMissingColumns=True), patched=True)


def watch(changes: DataFrame, store: GraphStore, tree: Callable[[], DataFrame], push: Callable[[dict], None], checkpoint: str):
    """Starts the feed: each micro-batch of changes (path) patches the store and pushes the new record."""

    def batch(df: DataFrame, _: int) -> None:
        paths = df.select(F.col("path").alias("file_path")).distinct()
        if not paths.isEmpty():
            push({"type": "graph:updated", **patch(store, tree(), paths)})

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def _drain(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all present input and returns what it wrote, from the shared folder."""
    import uuid

    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex[:10]}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream with a ``ts`` that watermarks accept; ``path`` is a parquet file or folder."""
    folder, _, file = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder) if file.endswith(".parquet") and not _is_dir(spark, path) else spark.readStream.schema(schema).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_counts(spark: SparkSession, path: str, size: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """``began, event_type, n, total``: closed event-time windows of the stream; with ``slide`` they overlap."""
    e = event_stream(spark, path).withWatermark("ts", delay)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    counts = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _drain(counts.select(F.col("w.start").alias("began"), "event_type", "n", "total"), spark, "windows")


def distinct_events(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """``event_id, user_id``: each event id once while the watermark allows for late copies."""
    e = event_stream(spark, path).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return _drain(e.select("event_id", "user_id"), spark, "distinct")


#: Waits before the attempts of a failed job, in seconds, and when a running job counts as stuck.
RETRY_WAITS, STUCK_AFTER = [5, 30, 120], 1800


def job_status(events: DataFrame, now: str) -> DataFrame:
    """``job, status, retry_at`` from job events (job, at, what: queued, started, succeeded, failed, cancelled): the
    last event decides; a failure is retried up to three times, a job running over half an hour is stuck."""
    last = events.groupBy("job").agg(F.max(F.struct("at", "what")).alias("l"), F.sum((F.col("what") == "failed").cast("int")).alias("failures"))
    what, at = F.col("l.what"), F.col("l.at")
    wait = F.try_element_at(F.array(*[F.lit(w) for w in RETRY_WAITS]), F.col("failures").cast("int"))
    age = F.timestamp_diff("SECOND", at, F.to_timestamp(F.lit(now)))
    status = F.when(what == "succeeded", "success").when(what == "cancelled", "cancelled").when((what == "failed") & (F.col("failures") > len(RETRY_WAITS)), "dead").when(what == "failed", "failed").when((what == "started") & (age > STUCK_AFTER), "dead").when(what == "started", "running").otherwise("pending")
    return last.select("job", status.alias("status"), F.when(status == "failed", F.timestamp_add("SECOND", wait, at)).alias("retry_at"))
