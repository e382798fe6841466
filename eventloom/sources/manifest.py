"""Tables of folders with a manifest that says which ones count.

A change writes new folders beside the old ones and then one small file
``_manifest/<version>.json``; readers go by the newest whole one. So a crash before
that file leaves the old state readable, and a batch whose name is in the manifest has
happened. One writer at a time. Manifests name folders, not rows, and stay small.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: Older manifests that are kept, so that readers which have just opened one are not disturbed.
KEPT = 5


class Folders:
    """The manifest below ``path``: any JSON object, ``{}`` before the first commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._root = self._path(f"{path}/_manifest")
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(self._root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def _file(self, version: int):
        return self._path(f"{self.path}/_manifest/{version}.json")

    def read(self) -> dict:
        versions = self._versions()
        if not versions:
            return {}
        stream = self._fs.open(self._file(versions[-1]))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, state: dict) -> None:
        versions = self._versions()
        draft = self._path(f"{self.path}/_manifest/_{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        stream.close()
        if not self._fs.rename(draft, self._file(versions[-1] + 1 if versions else 1)):
            raise RuntimeError(f"another writer committed to {self.path}")
        for old in versions[:-KEPT]:
            self._fs.delete(self._file(old), False)

    def drop(self, folder: str) -> None:
        """Remove a folder that no manifest in use names."""
        self._fs.delete(self._path(f"{self.path}/{folder}"), True)
