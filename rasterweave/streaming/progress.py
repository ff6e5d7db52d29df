"""Progress of a run from observed metrics, without another pass, and of a stream from its events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(frames: DataFrame, name: str = "frames", key: str = "frame_id") -> tuple[DataFrame, Observation]:
    """The same frames, and an observation of how many passed and the latest."""
    seen = Observation(name)
    return frames.observe(seen, F.count("*").alias("done"), F.max(key).alias("latest")), seen


def percent(done: int, total: int) -> int:
    """Rounded, within 0 and 100."""
    return max(0, min(100, int(5 + done / max(1, total) * 83 + 0.5)))


def stream_observed(frames: DataFrame, key: str = "i") -> DataFrame:
    """Streaming frames that report how many passed in a batch, and the latest, with the query's progress."""
    return frames.observe("frames", F.count("*").alias("done"), F.max(key).alias("latest"))


class ProgressListener(StreamingQueryListener):
    """The curve of one query: (batch, frames done so far, percent) after each batch, where percent is ``offset`` + the
    rounded share ``scale`` of the frames' progress, within 0 and 100, and never falls. Batches that are reported again count once."""

    def __init__(self, total: int, offset: int = 0, scale: float = 1.0):
        self.total, self.offset, self.scale = total, offset, scale
        self.done: dict[int, int] = {}
        self.curve: list[tuple[int, int, int]] = []
        self.error: str | None = None
        self.ended = False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("frames")
        if seen is None:
            return
        batch = event.progress.batchId
        self.done[batch] = seen["done"]
        done = sum(self.done.values())
        share = min(100.0, 5 + done / max(1, self.total) * 83)
        percent = max(0, min(100, self.offset + int(share * self.scale + 0.5)))
        self.curve = [c for c in self.curve if c[0] != batch]
        self.curve.append((batch, done, max([percent, *(c[2] for c in self.curve)])))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended, self.error = True, event.exception
