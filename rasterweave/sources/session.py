"""Session helpers: the library on workers, scratch folders and their lifetime."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver did."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


#: Folders of the runs that are open here, the innermost last.
_runs: ContextVar[tuple[str, ...]] = ContextVar("runs", default=())


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir,
    or a temporary one where a local session has none; a cluster has to name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the open run's folder, or without one in the shared folder."""
    top = _runs.get()[-1] if _runs.get() else shared(spark)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def run(spark: SparkSession) -> Iterator[str]:
    """Scratch folders made inside live until the run ends, well or not. What it returns has to be written before."""
    folder = f"{shared(spark)}/run-{uuid.uuid4().hex}"
    path, fs = _folder(spark, folder)
    fs.mkdirs(path)
    token = _runs.set((*_runs.get(), folder))
    try:
        yield folder
    finally:
        _runs.reset(token)
        fs.delete(path, True)


def sweep(spark: SparkSession, hours: float) -> int:
    """Delete the folders of runs that began more than ``hours`` ago, longer than any run takes: those
    whose driver died. How many there were."""
    path, fs = _folder(spark, shared(spark))
    now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
    old = [f.getPath() for f in fs.listStatus(path) if f.isDirectory() and f.getPath().getName().startswith("run-") and now - f.getModificationTime() > hours * 3_600_000] if fs.exists(path) else []
    for p in old:
        fs.delete(p, True)
    return len(old)


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, survives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
