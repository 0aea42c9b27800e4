"""Versions of a set of tables under one folder, and the pointer that says which one holds.

Every load writes a folder of its own. A small pointer file, made only when all
of it is written, switches readers to it; its number orders the loads. A load
that fails leaves the earlier version as it is, and a reader that has resolved
a version keeps its files, since the version before the present one stays.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import SparkSession

from promolift.sources.staging import delete

POINTER = "current-"
KEPT = 2


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        found = self._system.globStatus(self._path(f"{self.folder}/{pattern}")) or []
        return sorted(status.getPath().getName() for status in found)

    def _read(self, name: str) -> dict:
        stream = self._system.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def current(self) -> dict | None:
        """What the load in force left: ``folder`` with its path, ``tables`` with paths in it, and its ``totals``."""
        pointers = self._names(f"{POINTER}*")
        return self._read(pointers[-1]) if pointers else None

    def begin(self) -> str:
        """The folder of a new version."""
        pointers = self._names(f"{POINTER}*")
        number = 1 + int(pointers[-1].removeprefix(POINTER)) if pointers else 1
        return f"{self.folder}/version-{number:08d}-{uuid4().hex}"

    def commit(self, path: str, tables: dict, totals: dict[str, dict], uses: Iterable[str] = ()) -> None:
        """Switch readers to the version; fails if another load has switched since ``begin``.

        ``uses`` names folders of earlier versions that this one reads as well.
        """
        number = path.rsplit("/", 1)[1].split("-")[1]
        entry = {"folder": path, "tables": tables, "totals": totals, "uses": sorted({path, *uses})}
        stream = self._system.create(self._path(f"{self.folder}/{POINTER}{number}"), False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        self._clean()

    def _clean(self) -> None:
        """Delete what no version kept reads, loads that failed included."""
        pointers = self._names(f"{POINTER}*")
        for name in pointers[:-KEPT]:
            delete(self.spark, f"{self.folder}/{name}")
        kept = pointers[-KEPT:]
        used = {path.rsplit("/", 1)[1] for name in kept for path in self._read(name)["uses"]}
        for name in self._names("version-*"):
            if name not in used and name.split("-")[1] < kept[-1].removeprefix(POINTER):
                delete(self.spark, f"{self.folder}/{name}")
