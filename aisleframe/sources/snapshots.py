"""Tables as committed snapshots: data folders that never change, and one manifest per version.

A writer puts its rows into a new data folder and then publishes a manifest that lists the folders
of the version. Publishing is one rename that fails where the version already exists, so readers
see a version whole or not at all, a writer that fails leaves the last one as it was, and of two
writers with the same parent one is told. Older versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionTaken(RuntimeError):
    """Another writer has published this version."""


class Snapshots:
    """``folder/data/...`` and ``folder/versions/00000001.json``; any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(conf)

    def _file(self, version: int) -> str:
        return f"{self.folder}/versions/{version:08d}.json"

    def versions(self) -> list[int]:
        place = self._path(f"{self.folder}/versions")
        if not self._fs.exists(place):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of the newest version by default; an empty one before the first."""
        version = (self.versions() or [0])[-1] if version is None else version
        if version == 0:
            return {"version": 0, "folders": [], "marks": {}}
        stream = self._fs.open(self._path(self._file(version)))
        try:
            jvm = self.spark.sparkContext._jvm
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
            return json.loads(lines.readLine())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        folders = self.manifest(version)["folders"]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{f}" for f in folders])

    def _store(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        return name

    def _publish(self, parent: dict, folders: list[str], marks: dict) -> int:
        version = parent["version"] + 1
        text = json.dumps({"version": version, "folders": folders, "marks": parent["marks"] | marks})
        draft = self._path(f"{self.folder}/versions/.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray((text + "\n").encode()))
        out.close()
        target = self._path(self._file(version))
        # A rename onto an existing file fails or does nothing, by file system.
        done = False
        try:
            done = not self._fs.exists(target) and self._fs.rename(draft, target)
        finally:
            if not done:
                self._fs.delete(draft, False)
        if not done:
            raise VersionTaken(f"version {version} of {self.folder} exists")
        return version

    def append(self, rows: DataFrame, marks: dict | None = None, parent: dict | None = None) -> int:
        """A version with more rows. ``marks`` are small values kept with it (a batch number, say)."""
        parent = self.manifest() if parent is None else parent
        return self._publish(parent, [*parent["folders"], self._store(rows)], marks or {})

    def replace(self, change: Callable[[DataFrame], DataFrame], marks: dict | None = None) -> int:
        """A version whose rows are ``change`` of the newest version's."""
        parent = self.manifest()
        rows = change(self.read(parent["version"]))
        return self._publish(parent, [self._store(rows)], marks or {})

    def compact(self, most_folders: int, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int | None:
        """Rewrites the newest version into one folder if it has more than ``most_folders``."""
        if len(self.manifest()["folders"]) <= most_folders:
            return None
        return self.replace(change)

    def vacuum(self, keep: int) -> None:
        """Removes versions before the newest ``keep`` and the data that only they use.

        Data of writers that failed, or are still at work, is not touched.
        """
        versions = self.versions()
        old, new = versions[:-keep], versions[-keep:]
        held = {f for v in new for f in self.manifest(v)["folders"]}
        gone = {f for v in old for f in self.manifest(v)["folders"]} - held
        for v in old:
            self._fs.delete(self._path(self._file(v)), False)
        for f in gone:
            self._fs.delete(self._path(f"{self.folder}/data/{f}"), True)


def newest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Of rows with equal keys the one with the largest ``by``."""
    rest = [c for c in rows.columns if c not in (*keys, by)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("r"), F.max(by).alias(by)).select(
        *keys, *[f"r.{c}" for c in rest], by
    )
