"""Shared folder, written intermediate tables and small column helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"
    _written[path] = spark
    return path


def written(frame: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """The frame written once to the shared folder and read back, and its folder. Survives lost executors."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def staged(frame: DataFrame, name: str, **options: str) -> DataFrame:
    return written(frame, name, **options)[0]


def drop_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders that ``new_path`` has named and nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        if _written.pop(path, None) is not None:
            where = hadoop.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            drop_paths(spark, [path])


def _ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for module in sorted(package.rglob("*.py")):
                out.write(module, module.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(application)


def map_batches(frame: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    _ship(frame.sparkSession)
    return frame.mapInArrow(function, schema)


def map_groups(grouped: GroupedData, function: Callable, schema: str) -> DataFrame:
    """``applyInArrow`` with a function of this package."""
    _ship(grouped.session)
    return grouped.applyInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(key: str) -> Column:
    """Whether a row's key falls in the held-out fold; a null key hashes as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1
