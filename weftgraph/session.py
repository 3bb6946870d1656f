"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULT: dict[str, str] = {}


def build_session(app: str = "weftgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; anything already set by the cluster wins over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where a local session has not set it (tests), a temporary folder of this process is used; a
    session on a cluster without the setting is refused, since a machine-local folder would lose rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DEFAULT:
        folder = tempfile.mkdtemp(prefix="weftgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_DEFAULT[app] = "file://" + folder
    return _LOCAL_DEFAULT[app]


_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once per application, so that functions resolve there even
    where it is not installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="weftgraph-zip-"), "weftgraph")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), "weftgraph"))


class Stash:
    """Intermediate tables of one operator run, written to the shared folder so that lost executors cost a
    re-read and not a recomputation. ``put`` may name a slot; an older table in the slot is deleted once
    the new one is complete."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/weft-{name}-{os.getpid()}-{uuid.uuid4().hex[:10]}"
        self._slots: dict[str, str] = {}
        _WRITTEN.append(self.base)
        self._n = 0

    def put(self, df: DataFrame, slot: str) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{slot}-{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.drop(slot)
        self._slots[slot] = path
        return out

    def drop(self, slot: str) -> None:
        old = self._slots.pop(slot, None)
        if old:
            _delete(self.spark, old)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Deletes the intermediate tables this process has written. Results that still read them must have been
    consumed or written before."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
