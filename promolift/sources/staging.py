"""Intermediate tables in the shared folder of the cluster.

A written table cuts lineage, survives the loss of executors, and is read back
with column pruning and filter pushdown. The folder is the session's
``spark.checkpoint.dir``, else its warehouse, which executors share as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

Layout = Callable[[DataFrame], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/promolift/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``new_path`` has named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _as_is(frame: DataFrame) -> DataFrame:
    return frame


def materialize(frame: DataFrame, name: str, layout: Layout = _as_is) -> DataFrame:
    """The frame read back from a written copy. ``layout`` arranges the rows for it."""
    return Stage(frame.sparkSession).table(name, lambda: frame, layout)


class Stage:
    """Written tables that belong together and are deleted together."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def table(self, name: str, build: Callable[[], DataFrame], layout: Layout = _as_is) -> DataFrame:
        frame = build()
        path = new_path(self.spark, name)
        layout(frame).write.parquet(path)
        self.replace(name, path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def replace(self, name: str, path: str) -> None:
        """Own the folder under this name; an earlier one of the name is deleted."""
        if name in self.paths:
            delete(self.spark, self.paths[name])
        self.paths[name] = path

    def drop(self) -> None:
        for path in self.paths.values():
            delete(self.spark, path)
        self.paths.clear()


def state_of(spark: SparkSession, paths: Iterable[str]) -> tuple[str, ...]:
    """Changes when any file of the tables is added, removed or written again.

    Files at any depth are compared by path, length and time, their content is
    not read. The file system is asked once per depth of folders and no job runs.
    """
    place, to_text = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.java.util.Arrays.deepToString
    settings = spark._jsc.hadoopConfiguration()
    holder = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 1)
    states = []
    for path in paths:
        listed, pattern = hashlib.sha256(), path
        system = place(path).getFileSystem(settings)
        while found := system.globStatus(place(pattern)):
            holder[0] = found  # one text for all files of the depth
            # Reading a file may change when it was last read, which is no change of the table.
            listed.update(re.sub(r"access_time=\d+", "", to_text(holder)).encode())
            pattern += "/*"
        states.append(listed.hexdigest())
    return tuple(states)
