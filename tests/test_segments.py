"""Chunks leave their segments in order, under any order of arrival."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import schedule
from rasterweave.sources.session import scratch
from rasterweave.streaming import segments


def routed(spark, n, parts, chunk, lost=()):
    df = schedule.route(spark.range(n).withColumnRenamed("id", "i"), F.lit(n), F.lit(parts), F.lit(chunk)).where(~F.col("i").isin(*lost) if lost else F.lit(True))
    t = lambda i: F.timestamp_seconds(1_700_000_000 + i / 12)
    return df.select("seg", "chunk", "within", "expected", t(F.col("i")).alias("t"), t((F.col("seg") + 1) * -(-n // parts)).alias("ends"))


def run(spark, src, out, **options):
    with segments.keyed_state(spark):
        stream = spark.readStream.schema(segments.ROUTED).option("maxFilesPerTrigger", 1).parquet(src)
        q = segments.segment_stream(stream, **options).writeStream.option("checkpointLocation", out + "/state").trigger(availableNow=True)
        q = q.format("parquet").option("path", out + "/rows").start()
        q.awaitTermination()
    return q, sorted(map(tuple, spark.read.schema(segments.OUT).parquet(out + "/rows").collect()))


def feed(spark, src, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)


@pytest.mark.parametrize("seed", [1, 2])
def test_order_holds_under_shuffled_arrival(spark, seed):
    rng = np.random.default_rng(seed)
    src, out = scratch(spark, "in"), scratch(spark, "out")
    df = routed(spark, 200, 3, 20, lost=(25, 26, 190, *range(80, 100)))
    rows = [tuple(r) for r in df.collect()]
    rng.shuffle(rows)
    rows = [tuple(r) for r in rows] + [tuple(r) for r in rows[:50]]  # repeats, most of chunks that have left
    for k in range(4):
        feed(spark, src, rows[k::4], df.schema)
    _, early = run(spark, src, out)
    assert all(r[4] for r in early)  # before the end only complete chunks leave, those of a segment from the first
    for seg in {r[0] for r in early}:
        assert [r[2] for r in early if r[0] == seg] == list(range(sum(r[0] == seg for r in early)))
    segments.end_row(spark).write.mode("append").parquet(src)
    q, got = run(spark, src, out)  # resumes from its checkpoint
    want = sorted(map(tuple, segments.in_order(spark.createDataFrame(rows, df.schema)).select("seg", "place", "chunk", "frames", "complete").collect()))
    assert got == want and not all(r[4] for r in got)
    assert sum(s["numRowsTotal"] for p in q.recentProgress[-1:] for s in p["stateOperators"]) == 0


def test_a_segment_that_is_over_is_flushed_and_late_frames_are_lost(spark):
    src, out = scratch(spark, "in"), scratch(spark, "out")
    df = routed(spark, 240, 2, 60)  # 10 s a segment
    rows = [tuple(r) for r in df.orderBy("t").collect()]
    feed(spark, src, rows[:30] + rows[31:120], df.schema)
    feed(spark, src, rows[120:], df.schema)  # the watermark passes segment 0
    feed(spark, src, rows[30:31], df.schema)
    segments.end_row(spark).write.mode("append").parquet(src)
    _, got = run(spark, src, out, lateness="1 seconds")
    assert got == [(0, 0, 0, 59, False), (0, 1, 1, 60, True), (1, 0, 0, 60, True), (1, 1, 1, 60, True)]


def test_no_frames(spark):
    src, out = scratch(spark, "in"), scratch(spark, "out")
    segments.end_row(spark).write.parquet(src)
    assert run(spark, src, out)[1] == []
    assert segments.in_order(spark.createDataFrame([], segments.ROUTED)).count() == 0


def test_state_is_read_by_pages_of_chunks():
    """A batch of many open chunks costs an access or two a page, not some a chunk; all of it as the batch form has it."""
    import pandas as pd

    n = 60 * 3 * segments.PAGE
    rng = np.random.default_rng(3)
    i = rng.permutation(np.setdiff1d(np.arange(n), [0, 60 * 7 + 3]))  # the first chunk stays open, so all wait
    rows = pd.DataFrame({"seg": 0, "chunk": i // 60, "within": i % 60, "expected": 60, "ends": pd.Timestamp(2030, 1, 1)})

    class Map(dict):
        calls = 0

        def containsKey(self, k):
            Map.calls += 1
            return k in self

        def getValue(self, k):
            Map.calls += 1
            return self[k]

        def updateValue(self, k, v):
            Map.calls += 1
            self[k] = v

        removeKey, exists = dict.pop, dict.__len__

    class Value:
        held = None
        exists, get = (lambda self: self.held is not None), (lambda self: self.held)

        def update(self, v):
            self.held = v

        def clear(self):
            self.held = None

    class Waiting(list):  # what one state a chunk had besides
        exists, get, put = list.__len__, list.copy, list.extend

    class Handle:
        getMapState, getValueState, getListState = (lambda self, *a: Map()), (lambda self, *a: Value()), (lambda self, *a: Waiting())

        def registerTimer(self, t):
            pass

    order = segments.SegmentOrder()
    order.init(Handle())
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        got = pd.concat(order.handleInputRows((0,), iter(part[k : k + 10000] for k in range(0, len(part), 10000)), None))
        assert got.empty
    assert Map.calls < 40
    got = pd.concat(order.handleExpiredTimer((0,), None, None))
    assert got["chunk"].tolist() == got["place"].tolist() == list(range(3 * segments.PAGE))
    assert (got["complete"] == ~got["chunk"].isin([0, 7])).all() and got["frames"].sum() == n - 2
