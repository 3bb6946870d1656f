"""Folders and versioned tables on any file system Spark can reach; nothing here touches the driver's own disk."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """A folder on the file system its path names, through Hadoop's interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(self.at(name) if name else self.root))

    def names(self, prefix: str = "") -> list[str]:
        if not self.exists():
            return []
        return sorted(x for x in (s.getPath().getName() for s in self.fs.listStatus(self._path(self.root))) if x.startswith(prefix))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file appears under its name when it is complete."""
        hidden = self._path(self.at(f"_new-{uuid.uuid4().hex}"))
        stream = self.fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(hidden, self._path(self.at(name))):
            self.fs.delete(hidden, True)
            raise FileExistsError(self.at(name))

    def join_parts(self, parts: str, name: str, before: str, after: str, skip: int = 0) -> None:
        """One file of the bytes of all part files of a written folder between two texts, streamed from file to file;
        ``skip`` bytes of the first part that has any are left out."""
        out = self.fs.create(self._path(self.at(name)), True)
        try:
            out.write(bytearray(before.encode()))
            status = sorted(self.fs.listStatus(self._path(self.at(parts))), key=lambda s: s.getPath().getName())
            for s in status:
                if s.getPath().getName().startswith("part-") and s.getLen() > 0:
                    stream = self.fs.open(s.getPath())
                    try:
                        stream.seek(skip)
                        skip = 0
                        self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, self._conf, False)
                    finally:
                        stream.close()
            out.write(bytearray(after.encode()))
        finally:
            out.close()


class Versions:
    """Named tables in versions that are never changed. Publishing adds a small numbered record; readers take the
    record with the highest number, so they see a whole version or the one before. The last ``keep`` versions stay."""

    RECORD = "current-"

    def __init__(self, spark: SparkSession, root: str, keep: int = 1):
        self.spark, self.folder, self.keep = spark, Folder(spark, root), keep

    def current(self) -> dict | None:
        for name in reversed(self.folder.names(self.RECORD)):
            try:
                return json.loads(self.folder.read(name))
            except Exception:  # noqa: BLE001  a record that is being replaced or unreadable
                continue
        return None

    def stage(self, tables: dict[str, DataFrame], partitions: dict[str, list[str]] | None = None) -> str:
        version = f"{time.time_ns():020d}"
        for name, df in tables.items():
            df.write.partitionBy(*(partitions or {}).get(name, [])).parquet(self.folder.at(f"v={version}/{name}"))
        return version

    def complete(self, version: str, names: list[str]) -> bool:
        return all(self.folder.exists(f"v={version}/{n}/_SUCCESS") for n in names)

    def publish(self, version: str, names: list[str], **meta) -> dict:
        if not self.complete(version, names):
            raise ValueError(f"version {version} lacks one of {names}")
        record = {"version": version, "indexedAt": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **meta}
        before = self.folder.names(self.RECORD)
        self.folder.write(f"{self.RECORD}{time.time_ns():020d}", json.dumps(record))
        for name in before:
            self.folder.delete(name)
        for old in self.versions()[: -self.keep]:
            if old != version:
                self.folder.delete(f"v={old}")
        return record

    def abort(self, version: str) -> None:
        if (self.current() or {}).get("version") != version:
            self.folder.delete(f"v={version}")

    def versions(self) -> list[str]:
        return [x[2:] for x in self.folder.names("v=")]

    def table(self, name: str) -> DataFrame:
        record = self.current()
        if record is None:
            raise FileNotFoundError(self.folder.root)
        return self.spark.read.parquet(self.folder.at(f"v={record['version']}/{name}"))

    def save(self, tables: dict[str, DataFrame], partitions: dict[str, list[str]] | None = None, **meta) -> dict:
        return self.publish(self.stage(tables, partitions), list(tables), **meta)
