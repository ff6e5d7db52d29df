"""Lifetime of scratch folders, previews, progress events and resampling."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.operators import point
from rasterweave.plans import registry
from rasterweave.sources import session
from rasterweave.streaming import preview, progress


def folders(spark):
    return sorted(os.listdir(session.shared(spark).removeprefix("file://")))


def test_a_run_takes_its_folders_with_it(spark, sf_dir):
    before = folders(spark)
    with session.run(spark) as folder:
        rows = registry.QUERIES["clean_speckles"](spark, sf_dir).collect()
        session.written(spark.range(3), "mine")
        assert len(os.listdir(folder.removeprefix("file://"))) >= 2 and len(folders(spark)) == len(before) + 1
    assert rows and folders(spark) == before
    with pytest.raises(ZeroDivisionError), session.run(spark):
        session.written(spark.range(3), "mine")
        with session.run(spark):
            session.written(spark.range(3), "inner")
        1 / 0
    assert folders(spark) == before
    assert session.scratch(spark, "x").startswith(session.shared(spark) + "/x-")


def test_sweep_takes_what_dead_runs_left(spark):
    root = session.shared(spark).removeprefix("file://")
    for name, age in (("run-dead", 30 * 3600), ("run-young", 60), ("other-dead", 30 * 3600)):
        os.makedirs(f"{root}/{name}/rows")
        os.utime(f"{root}/{name}", (time.time() - age,) * 2)
    assert session.sweep(spark, 24) == 1
    assert not os.path.exists(f"{root}/run-dead") and os.path.exists(f"{root}/run-young") and os.path.exists(f"{root}/other-dead")


def batch(spark, rows):
    return spark.createDataFrame(rows, "seg long, i long, png string")


def test_previews_never_go_back(spark):
    folder = session.scratch(spark, "preview")
    show = preview.keep_newest(folder)
    now = lambda: {r.seg: (r.i, r.png) for r in preview.shown(spark, folder).collect()}
    show(batch(spark, [(0, 5, "five"), (0, 9, "nine"), (1, 3, "three")]), 0)
    assert now() == {0: (9, "nine"), 1: (3, "three")}
    show(batch(spark, [(0, 7, "late"), (1, 4, "four")]), 1)
    assert now() == {0: (9, "nine"), 1: (4, "four")}
    show(batch(spark, [(0, 12, "twelve")]), 2)
    latest = now()
    show(batch(spark, [(0, 7, "late"), (1, 4, "four")]), 1)  # replayed
    assert now() == latest == {0: (12, "twelve"), 1: (4, "four")}
    show(batch(spark, [(0, 12, "twelve")]), 2)  # replayed
    show(batch(spark, []), 3)
    assert now() == latest and len(preview.snapshots(spark, folder)) <= preview.KEPT + 1


def test_progress_events_follow_the_curve(spark):
    src, out = session.scratch(spark, "in"), session.scratch(spark, "out")
    for k in range(3):
        spark.range(k * 40, k * 40 + 40).withColumnRenamed("id", "i").coalesce(1).write.mode("append").parquet(src)
    listener = progress.ProgressListener(120, 88, 0.04)
    spark.streams.addListener(listener)
    try:
        frames = progress.stream_observed(spark.readStream.schema("i long").option("maxFilesPerTrigger", 1).parquet(src))
        q = frames.writeStream.format("parquet").option("path", out + "/rows").option("checkpointLocation", out + "/state").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if listener.ended and len(listener.curve) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    from rasterweave.functions import schedule

    at = spark.range(120).select("id", schedule.progress(88, 0.04, F.least(F.lit(100.0), 5 + (F.col("id") + 1) / 120 * 83)).alias("p"))
    curve = {r.id: r.p for r in at.collect()}  # as the query progress_curve has it
    assert listener.curve == [(k, 40 * k + 40, curve[40 * k + 39]) for k in range(3)] and listener.error is None


def area_mean(a, scale):
    """By the definition, with fractions in double precision."""
    h, w = a.shape
    th, tw = max(1, int(h * scale + 0.5)), max(1, int(w * scale + 0.5))

    def weights(n, t):
        m = np.zeros((t, n))
        for k in range(t):
            for s in range(n):
                m[k, s] = max(0.0, min((s + 1) * t, (k + 1) * n) - max(s * t, k * n))
        return m / n

    return weights(h, th) @ a @ weights(w, tw).T


@pytest.mark.parametrize("scale", [1.0, 0.75, 0.5, 0.31, 0.01])
def test_resampling_weighs_by_area(spark, scale):
    like = [np.random.default_rng(3).integers(0, 256, shape) for shape in ((13, 22), (1, 1), (4, 64), (7, 3))]
    rows = [(k, y, x, int(a[y, x])) for k, a in enumerate(like) for y in range(a.shape[0]) for x in range(a.shape[1])]
    got = point.resample(spark.createDataFrame(rows, "frame_id long, y int, x int, v int"), scale).collect()
    for k, a in enumerate(like):
        want = area_mean(a, scale)
        own = {(r.y, r.x): r.v for r in got if r.frame_id == k}
        assert len(own) == want.size
        assert all(abs(own[y, x] - want[y, x]) <= 0.5 + 1e-9 for y in range(want.shape[0]) for x in range(want.shape[1]))
        assert abs(np.mean(list(own.values())) - a.mean()) <= 0.5 + 1e-9
