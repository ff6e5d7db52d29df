"""Chunks that fire once when their last frame has arrived."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterweave.sources.session import ship

OUT = "seg long, chunk long, frames long"
STATE = "seen binary, fired boolean"


def completed(routed: DataFrame) -> DataFrame:
    """Batch form: (seg, chunk, frames) of chunks with all expected frames."""
    done = routed.groupBy("seg", "chunk").agg(F.countDistinct("within").alias("frames"), F.max("expected").alias("expected"))
    return done.where("frames = expected").select("seg", "chunk", "frames")


def fire_once(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Marks a chunk's frames over micro-batches, in any order and however often they come; emits the
    chunk when all expected ones are marked. Of a chunk that has fired only that stays in the state."""
    marks, fired = state.get if state.exists else (b"", False)
    if fired:
        for _ in batches:  # late repeats
            pass
        return
    seen, expected = int.from_bytes(marks, "little"), 0
    for b in batches:
        for within in b["within"].unique().tolist():
            seen |= 1 << within
        expected = max(expected, int(b["expected"].max()))
    frames = seen.bit_count()
    if expected and frames >= expected:
        state.update((b"", True))
        yield pd.DataFrame({"seg": [key[0]], "chunk": [key[1]], "frames": [frames]})
    else:
        state.update((seen.to_bytes(-(-seen.bit_length() // 8), "little"), False))


def completed_stream(routed: DataFrame) -> DataFrame:
    """Streaming form of ``completed``: repeats count once, as there."""
    ship(routed.sparkSession)
    return routed.groupBy("seg", "chunk").applyInPandasWithState(fire_once, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def frame_stream(spark, folder: str, schema, files: str = "*.parquet", most_files: int = 16) -> DataFrame:
    """Frames as they are added to a folder, at most ``most_files`` files a micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", most_files).parquet(folder)
