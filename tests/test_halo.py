"""Renders on tiles with a halo equal those on whole frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.operators import clahe, lineart, tiling
from rasterweave.plans import model

import reference_frames as frames

CUSTOM = dict(custom=True, gaussian=True, median=True, clean_intensity=2, merge_intensity=1, color_edges=True, color_line_weight=2)
RENDERS = {
    "blueprint": model.Settings(preset=model.preset("blueprint"), line_weight=3),
    "custom": model.Settings(preset=model.preset("custom", diameter=5), dark_boost=True, color_softness=2, color_opacity=0.5, bilateral_passes=1, **CUSTOM),
}


def pictures():
    rng = np.random.default_rng(12)
    smooth = np.kron(rng.integers(0, 256, (6, 9, 3)), np.ones((8, 8, 1), int))
    return [np.clip(smooth + rng.integers(-20, 21, smooth.shape), 0, 255), rng.integers(0, 70, (23, 17, 3)), rng.integers(0, 256, (1, 40, 3))]


def table(spark, like):
    rows = [(k, y, x, *map(int, a[y, x])) for k, a in enumerate(like) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "frame_id long, y int, x int, r int, g int, b int")


@pytest.mark.parametrize("name", RENDERS)
def test_tiles_equal_whole_frames(spark, name):
    like = pictures()
    out = lineart.line_art(table(spark, like), RENDERS[name], tile=20)
    got = [np.full_like(a, -1) for a in like]
    for r in out.collect():
        got[r.frame_id][r.y, r.x] = (r.r, r.g, r.b)
    for a, b in zip(like, got):
        assert (frames.line_art(a.astype(np.uint8), RENDERS[name]) == b).all(), a.shape


def test_clahe_by_cells_equals_windows(spark):
    like = [np.random.default_rng(1).integers(0, 256, shape) for shape in ((16, 24), (13, 11), (1, 1), (3, 40), (9, 1), (70, 64))]
    rows = [(k, y, x, int(a[y, x]), "kept") for k, a in enumerate(like) for y in range(a.shape[0]) for x in range(a.shape[1])]
    px = spark.createDataFrame(rows, "frame_id long, y int, x int, v int, other string")
    got = [np.full_like(a, -1) for a in like]
    for r in tiling.Tiles(16).clahe(px, 4.0).collect():
        got[r.frame_id][r.y, r.x] = r.v
        assert r.other == "kept"
    for a, b in zip(like, got):
        assert (frames.clahe(a, 4.0) == b).all(), a.shape
    assert clahe.by_cells(px.where("false").withColumn("_h", F.lit(1)).withColumn("_w", F.lit(1)), 4.0).count() == 0


def test_a_1080p_frame_is_many_tasks(spark):
    """Bars on a plain ground: their edges become lines of the weight asked for, in every tile."""
    w, h = 1920, 1080
    p = spark.range(w * h).select(F.lit(7).cast("long").alias("frame_id"), F.expr(f"cast(id div {w} as int)").alias("y"), F.expr(f"cast(id % {w} as int)").alias("x"))
    v = F.when(F.col("x") % 240 < 120, 220).otherwise(40)
    px = p.select("*", *[v.alias(c) for c in "rgb"])
    s = model.Settings(preset=model.preset("custom"), custom=True, bilateral=False, auto_normalize=False, clean_speckles=True, merge_double_edge=False, line_weight=1)
    out = lineart.line_art(px, s, tile=256)
    rows = out.where("r = 0").groupBy("x").count().collect()
    columns = {r.x: r["count"] for r in rows}
    assert set(columns.values()) == {h}  # each line goes through all tiles
    whole = frames.line_art(np.repeat(np.where(np.arange(w) % 240 < 120, 220, 40)[None, :, None], 60, 0).repeat(3, 2).astype(np.uint8), s)
    assert set(columns) == set(np.flatnonzero((whole[30] == 0).all(1)).tolist())
    assert out.rdd.getNumPartitions() > 1


def test_clahe_by_cells_makes_no_table_of_all_levels(spark):
    """Small tiles cost what their pixels do, not 256 levels each, let alone the square of that."""
    rng = np.random.default_rng(4)
    like = [rng.integers(0, 256, (8, 8)) for _ in range(5)]
    px = spark.createDataFrame([(k, y, x, int(a[y, x])) for k, a in enumerate(like) for y in range(8) for x in range(8)], "frame_id long, y int, x int, v int")
    out = tiling.Tiles(4).clahe(px, 4.0)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = [np.full_like(a, -1) for a in like]
    for r in out.collect():
        got[r.frame_id][r.y, r.x] = r.v
    assert all((frames.clahe(a, 4.0) == b).all() for a, b in zip(like, got))
