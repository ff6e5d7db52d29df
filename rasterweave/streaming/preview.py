"""Live preview: the newest frame of each segment, whatever batches are late or replayed.

Each micro-batch writes a snapshot named after its id: of every segment the frame with the largest index in the batch
and in the snapshot before. A batch that is replayed starts from the same one before it and so writes the same again; a
late frame is smaller than what is shown and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.sources.session import _folder

KEPT = 2


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Ids of whole snapshots, in order."""
    path, fs = _folder(spark, folder)
    if not fs.exists(path):
        return []
    found = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("batch-")]
    jvm = spark.sparkContext._jvm
    return sorted(int(p.getName()[6:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def newest(frames: DataFrame, key: str = "seg", index: str = "i") -> DataFrame:
    """Of each key the row with the largest index; rows have other columns as they like. Combined before the shuffle."""
    row = F.struct(*[F.col(c) for c in frames.columns])
    return frames.groupBy(key).agg(F.max_by(row, index).alias("row")).select("row.*")


def keep_newest(folder: str, key: str = "seg", index: str = "i") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``."""

    def show(frames: DataFrame, batch: int) -> None:
        spark = frames.sparkSession
        before = [b for b in snapshots(spark, folder) if b < batch]
        rows = frames
        if before:
            rows = rows.unionByName(spark.read.schema(frames.schema).parquet(f"{folder}/batch-{before[-1]}"))
        newest(rows, key, index).write.mode("overwrite").parquet(f"{folder}/batch-{batch}")
        for old in before[: -KEPT + 1]:
            path, fs = _folder(spark, f"{folder}/batch-{old}")
            fs.delete(path, True)

    return show


def shown(spark: SparkSession, folder: str) -> DataFrame:
    """What the latest snapshot shows."""
    return spark.read.parquet(f"{folder}/batch-{snapshots(spark, folder)[-1]}")
