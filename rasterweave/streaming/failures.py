"""Failures of single frames: rows of a report, and one exception after the batch.

A frame that fails does not stop the others of its batch. Metrics observed while outcomes are
written say whether any failed and which was the first, so nothing is run again; then the first failure by
index is raised. A stream does the same for each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rasterweave.sources.session import ship


class FrameError(Exception):
    """The first frame that failed: index and reason, and how many did."""

    def __init__(self, index: int, reason: str, failed: int):
        super().__init__(f"frame {index}: {reason} ({failed} failed)")
        self.index, self.reason, self.failed = index, reason, failed


def attempted(frames: DataFrame, step: Callable[[dict], dict], schema: str, key: str = "frame_id") -> DataFrame:
    """(key, columns of ``schema``, error): ``step`` on each row as a dict; where it raises, its columns are null and error says why."""
    ship(frames.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    rows.append({**step(row), key: row[key], "error": None})
                except Exception as e:  # any failure of a frame is a row
                    rows.append({key: row[key], "error": f"{type(e).__name__}: {e}"})
            columns = [key, *names, "error"]
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})

    kind = dict(frames.dtypes)[key]
    return frames.mapInPandas(run, f"{key} {kind}, {schema}, error string")


def settle(outcomes: DataFrame, path: str, key: str = "frame_id") -> None:
    """Write all outcomes to ``path``; then raise the first failure by key, if any."""
    seen = Observation()
    failed = F.col("error").isNotNull()
    first = F.min(F.when(failed, F.struct(key, "error")))
    outcomes.observe(seen, F.count(F.when(failed, 1)).alias("failed"), first.getField(key).alias("first"), first.getField("error").alias("reason")).write.mode("overwrite").parquet(path)
    got = seen.get
    if got["failed"]:
        raise FrameError(got["first"], got["reason"], got["failed"])


def settling(folder: str, key: str = "frame_id") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch's outcomes in a folder of their own, written anew if it is replayed."""
    return lambda outcomes, batch: settle(outcomes, f"{folder}/batch={batch}", key)


def report(spark, path: str, key: str = "frame_id") -> DataFrame:
    """(key, error) of what failed."""
    return spark.read.parquet(path).where("error is not null").select(key, "error")
