"""Chunks of a segment in their order, whatever order their frames arrive in.

State is kept by segment: what has arrived of its open chunks, complete ones whose turn has not come among them, and whose
turn it is. A chunk leaves when it is complete and all before it have left.
When the watermark passes the segment's end a timer hands on what remains, incomplete chunks too and still in order, and
clears the segment's state. Input ends with one row of time ``END``, which takes the watermark past all segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rasterweave.sources.session import ship

OUT = "seg long, place long, chunk long, frames long, complete boolean"
#: Routed frames with the time of the frame, and of the last frame of its segment.
ROUTED = "seg long, chunk long, within long, expected long, t timestamp, ends timestamp"
END = "9000-01-01 00:00:00"
#: Chunks to an entry of state.
PAGE = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(routed: DataFrame) -> DataFrame:
    """Batch form of ``segment_stream``: each segment's chunks that have a frame, numbered in order."""
    g = routed.groupBy("seg", "chunk").agg(F.countDistinct("within").alias("frames"), F.max("expected").alias("expected"))
    place = F.row_number().over(Window.partitionBy("seg").orderBy("chunk")) - 1
    return g.select("seg", place.cast("long").alias("place"), "chunk", "frames", (F.col("frames") == F.col("expected")).alias("complete"))


class SegmentOrder(StatefulProcessor):
    """Open chunks are kept in pages of ``PAGE``: one entry of state has the page's marks as rows of bits, and what each chunk
    expects, so that a batch costs an access a page it touches, and rows are marked by array operations."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getMapState("marks", "page long", "seen binary, expected binary")
        self.turn = handle.getValueState("turn", "chunk long, place long")

    def page(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a page's chunks: their marks, a byte for 8 frames, and how many frames they expect, 0 if none is here."""
        if not self.marks.containsKey((k,)):
            return np.zeros((PAGE, 0), np.uint8), np.zeros(PAGE, np.int64)
        seen, expected = self.marks.getValue((k,))
        return np.frombuffer(seen, np.uint8).reshape(PAGE, -1).copy(), np.frombuffer(expected, np.int64).copy()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (seg,) = key
        chunk, place = self.turn.get() if self.turn.exists() else (0, 0)
        pages: dict[int, tuple] = {}
        for batch in rows:
            if not self.turn.exists():
                self.turn.update((chunk, place))
                self.handle.registerTimer(int(batch["ends"].max().timestamp() * 1000))
            c, within, expected = (batch[n].to_numpy(np.int64) for n in ("chunk", "within", "expected"))
            here = c >= chunk  # what has left is over
            c, within, expected = c[here], within[here], expected[here]
            for k in np.unique(c // PAGE).tolist():
                own = c // PAGE == k
                seen, most = pages[k] if k in pages else self.page(k)
                wide = int(within[own].max()) // 8 + 1
                if wide > seen.shape[1]:
                    seen = np.pad(seen, ((0, 0), (0, wide - seen.shape[1])))
                np.bitwise_or.at(seen, (c[own] % PAGE, within[own] // 8), np.left_shift(1, within[own] % 8).astype(np.uint8))
                np.maximum.at(most, c[own] % PAGE, expected[own])
                pages[k] = seen, most
        out, k = [], chunk // PAGE
        while True:  # pages that have their turn, as long as they are complete to their end
            seen, most = pages[k] if k in pages else self.page(k)
            frames = np.bitwise_count(seen).sum(1, dtype=np.int64)
            ready = (most > 0) & (frames >= most)
            end = chunk % PAGE
            end += int(np.argmin(np.append(ready[end:], False)))
            own = np.arange(chunk % PAGE, end)
            if len(own):
                out.append(pd.DataFrame({"seg": seg, "place": place + np.arange(len(own)), "chunk": k * PAGE + own, "frames": frames[own], "complete": True}))
                seen[own], most[own] = 0, 0
                pages[k] = seen, most
                chunk, place = k * PAGE + end, place + len(own)
            if end < PAGE:
                break
            k += 1
        for k, (seen, most) in pages.items():
            if most.any():
                self.marks.updateValue((k,), (seen.tobytes(), most.tobytes()))
            elif self.marks.containsKey((k,)):
                self.marks.removeKey((k,))
        if out:
            self.turn.update((chunk, place))
        yield from out or [self.rows([])]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The segment is over: what remains leaves in order, and nothing is kept."""
        (seg,) = key
        _, place = self.turn.get() if self.turn.exists() else (0, 0)
        for k in sorted(k for (k,) in self.marks.keys()) if self.marks.exists() else []:
            seen, most = self.page(k)
            own = np.flatnonzero(most)
            frames = np.bitwise_count(seen[own]).sum(1, dtype=np.int64)
            yield pd.DataFrame({"seg": seg, "place": place + np.arange(len(own)), "chunk": k * PAGE + own, "frames": frames, "complete": frames >= most[own]})
            place += len(own)
        for state in (self.marks, self.turn):
            state.clear()
        yield self.rows([])

    def close(self) -> None:
        pass

    @staticmethod
    def rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["seg", "place", "chunk", "frames", "complete"]).astype({"seg": "int64", "place": "int64", "chunk": "int64", "frames": "int64", "complete": bool})


def segment_stream(routed: DataFrame, lateness: str = "3650 days") -> DataFrame:
    """Streaming form of ``in_order``: (seg, place, chunk, frames, complete), place counting what left a segment.

    ``routed`` has the columns of ``ROUTED``, with times after 1970. Frames may come in any order and more than once; those later than ``lateness``
    behind the newest are lost once their segment is over, and count as missing."""
    ship(routed.sparkSession)
    # compares the event time, so that the end row passes the watermark before it goes
    frames = routed.withWatermark("t", lateness).where(F.col("t") < F.lit(END).cast("timestamp"))
    return frames.groupBy("seg").transformWithStateInPandas(SegmentOrder(), OUT, "append", "eventTime")


def end_row(spark: SparkSession) -> DataFrame:
    """What is appended to the input when no more frames come."""
    return spark.range(1).select(*[F.lit(None).cast("long").alias(c) for c in ("seg", "chunk", "within", "expected")], F.lit(END).cast("timestamp").alias("t"), F.lit(END).cast("timestamp").alias("ends"))


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, as lists, maps and timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
