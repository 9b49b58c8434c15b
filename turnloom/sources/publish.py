"""Tables that are replaced as a whole: readers see the old version or the new one, never a part.

A version is a folder of its own, written by Spark's writers, whose tasks commit their files when they end.  It
counts only once its manifest is there: a small file under ``_versions`` with the version's number, its
parent, its folder and the names and bytes of its files.  The manifest is written beside and takes its name by a
rename that fails if the name is taken, so of two writers of one parent one loses (``Conflict``) and no
version is lost.  A write that fails removes its folder; what a killed writer left is removed by ``vacuum``.

Works in any store that Spark writes to and that renames a single file at once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has published since the version that this one began with."""


class Store:
    """The published versions below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """Numbers of the published versions, ascending."""
        at = self._at("_versions")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """Of a version, or of the last; None where nothing is published."""
        known = self.versions()
        version = known[-1] if version is None and known else version
        if version not in known:
            return None
        stream = self._fs.open(self._at(f"_versions/{version:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, schema: str, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the last; none where nothing is published."""
        found = self.manifest(version)
        if found is None:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{found['folder']}/{f['name']}" for f in found["files"]]
        return self.spark.read.schema(schema).option("mode", "FAILFAST").json(paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, df: DataFrame, write: Callable[[DataFrame, str], None] | None = None, parent: int | None = None) -> int:
        """Writes df (as JSON lines, or by write(df, folder)) and publishes it after parent (default: the last version)."""
        known = self.versions()
        parent = parent if parent is not None else (known[-1] if known else 0)
        folder = f"data-{uuid.uuid4().hex}"
        try:
            if write:
                write(df, f"{self.path}/{folder}")
            else:
                df.write.option("ignoreNullFields", "true").json(f"{self.path}/{folder}")
            files = [s for s in self._fs.listStatus(self._at(folder)) if s.isFile() and s.getPath().getName()[0] not in "_."]
            entry = {"version": parent + 1, "parent": parent, "folder": folder, "files": [{"name": s.getPath().getName(), "bytes": s.getLen()} for s in files]}
            self._claim(parent + 1, json.dumps(entry))
        except BaseException:
            self._fs.delete(self._at(folder), True)
            raise
        return parent + 1

    def _claim(self, version: int, text: str) -> None:
        beside, name = self._at(f"_versions/.{uuid.uuid4().hex}"), self._at(f"_versions/{version:020d}.json")
        out = self._fs.create(beside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(beside), self._fs.makeQualified(name), options)
        except Exception as e:
            self._fs.delete(beside, False)
            if "AlreadyExists" in str(e) or self._fs.exists(name):
                raise Conflict(f"version {version} of {self.path} is there already") from e
            raise

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the last keep versions and what no version holds; call it while nobody writes.  The folders removed."""
        kept = {self.manifest(v)["folder"] for v in self.versions()[-keep:]} if keep else set()
        gone = []
        for s in self._fs.listStatus(self._at("")):
            name = s.getPath().getName()
            if name.startswith("data-") and name not in kept:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        for v in self.versions()[: -keep or None]:
            self._fs.delete(self._at(f"_versions/{v:020d}.json"), False)
        return gone

