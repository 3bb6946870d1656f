"""Tables derived from input tables, built once and kept on the shared file system.

A published version belongs to the files it was made from: their names, lengths and times are its key, so changed
input gives a new one. Readers see a whole version or none, in which case they build it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.session import shared_dir
from weftgraph.sources.folder import Versions


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A key of the files under the paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = hashlib.sha256()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        found, files = [], fs.listFiles(p, True)
        while files.hasNext():
            s = files.next()
            found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
        seen.update("\n".join([path, *sorted(found)]).encode())
    return seen.hexdigest()[:20]


def published(spark: SparkSession, paths: list[str], name: str, build: Callable[[], dict[str, DataFrame]], partitions: dict[str, list[str]] | None = None, kind: type[Versions] = Versions) -> Versions:
    """The version called ``name`` of what ``build`` makes of the files under ``paths``."""
    store = kind(spark, f"{shared_dir(spark)}/weft-published/{name}-{fingerprint(spark, paths)}")
    if store.current() is None:
        store.save(build(), partitions)
    return store
