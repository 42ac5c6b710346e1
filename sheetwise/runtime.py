"""Session helpers: shared scratch tables that cut lineage, and shipping this package to the executors."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may leave the setting out; it then gets a new folder under /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own[app]


def cut_to(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; returns the table read back, and its path. It goes with the application, if not before."""
    path = f"{shared_dir(spark)}/sheetwise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """As :func:`cut_to`, for tables that a result needs: they stay until the application ends, which deletes them."""
    return cut_to(spark, df)[0]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function like :func:`cut` whose tables are deleted at the end of the block; nothing lazy may need them after it."""
    paths: list[str] = []

    def own(df: DataFrame) -> DataFrame:
        made, path = cut_to(spark, df)
        paths.append(path)
        return made

    try:
        yield own
    finally:
        for p in paths:
            remove(spark, p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`cut_to` wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark deletes the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    name = f"sheetwise-{sc.applicationId}.zip"
    if name in _own:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)  # the driver's own; Spark sends it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _own[name] = path
