"""Connectivity across tiles, on frames larger than one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.operators import connect, graph

import reference_frames as frames


def pixels(spark, arrays, kind="int"):
    rows = [(k, y, x, int(a[y, x]), y + x) for k, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, f"frame_id long, y int, x int, m {kind}, other int")


def images():
    rng = np.random.default_rng(5)
    comb = np.zeros((40, 61), int)
    comb[:, ::2] = 2
    comb[0], comb[1, ::4] = 2, 0
    spiral = np.zeros((33, 33), int)
    for k in range(0, 16, 2):
        spiral[k, k : 33 - k] = spiral[32 - k, k : 33 - k] = spiral[k : 33 - k, k] = spiral[k : 33 - k, 32 - k] = 1
        spiral[k + 1, k] = 0
        spiral[k + 2, k + 1] = 1
    diagonal = np.eye(50, dtype=int) + np.eye(50, dtype=int)[:, ::-1]
    return [comb, spiral, np.minimum(diagonal, 2), *[rng.choice([0, 1, 2], (47, 52), p=p) for p in ([0.6, 0.3, 0.1], [0.5, 0.49, 0.01], [0.9, 0.1, 0])], np.ones((1, 30), int), np.zeros((9, 9), int), np.full((1, 1), 2)]


RULES = {"closure": connect.closure, "component": connect.component, "specks": connect.without_specks(12)}


@pytest.mark.parametrize("size", [7, 16])
@pytest.mark.parametrize("name", RULES)
def test_tiles_equal_whole_frames(spark, name, size):
    like = images()
    out = connect.connect(pixels(spark, like), {"m": RULES[name]}, size)
    got = [np.full_like(a, -1) for a in like]
    for r in out.collect():
        got[r.frame_id][r.y, r.x] = r.m
        assert r.other == r.y + r.x
    for a, b in zip(like, got):
        h, w = a.shape
        assert (RULES[name](a.ravel(), np.array([w]), np.array([h])).reshape(h, w) == b).all()
        if name == "closure":
            assert ((b > 0) == frames.hysteresis(a == 2, a >= 1)).all()
        elif name == "component":
            assert (b == frames.label(a > 0)).all()


def test_two_planes_at_once(spark):
    a, b = images()[3:5]
    px = pixels(spark, [a]).withColumn("n", F.lit(None).cast("long"))
    both = pixels(spark, [b]).select("frame_id", "y", "x", F.col("m").cast("long").alias("n"))
    out = connect.connect(px.drop("n").join(both, ["frame_id", "y", "x"]), {"m": connect.closure, "n": connect.component}, 10)
    m, n = np.zeros_like(a), np.zeros_like(b)
    for r in out.collect():
        m[r.y, r.x], n[r.y, r.x] = r.m, r.n
    assert ((m > 0) == frames.hysteresis(a == 2, a >= 1)).all() and (n == frames.label(b > 0)).all()


def test_contraction_equals_union_find(spark):
    rng = np.random.default_rng(2)
    links = [(k, int(u), int(v)) for k in (1, 2) for u, v in rng.integers(0, 400, (330, 2))] + [(3, i, i + 1) for i in range(300)] + [(4, 0, i) for i in range(1, 200)] + [(5, 7, 7)]
    got = {(r.k, r.node): r.root for r in graph.contract(spark.createDataFrame(links, "k int, u long, v long"), ["k"]).collect()}
    for k in range(1, 6):
        own = np.array([(u, v) for q, u, v in links if q == k])
        label = connect.roots(1000, own[:, 0], own[:, 1])
        assert {n: r for (q, n), r in got.items() if q == k} == {i: int(r) for i, r in enumerate(label) if r != i}
    assert graph.contract(spark.createDataFrame([], "k int, u long, v long"), ["k"]).count() == 0


def test_a_4k_frame(spark):
    """A comb that crosses all tiles is one component, and of specks between its teeth the small ones go; no row holds more than a tile."""
    w, h = 3840, 2160
    p = spark.range(w * h).select(F.lit(0).cast("long").alias("frame_id"), F.expr(f"cast(id div {w} as int)").alias("y"), F.expr(f"cast(id % {w} as int)").alias("x"))
    speck = "x % 16 between 6 and 8 and y > 8 and (y % 32 = 5 or (y % 32 = 6 and x % 32 < 16))"  # 3 pixels, or 6
    px = p.withColumn("m", F.expr(f"case when x % 16 = 0 or y = 0 then 255 when {speck} then 255 else 0 end"))
    tiles = connect.pack(px)
    assert tiles.agg(F.max(F.size("m"))).first()[0] == connect.TILE**2 and tiles.count() == 15 * 9
    out = connect.connect(px, {"m": connect.without_specks(4)})
    lost = px.where("m = 255").count() - out.where("m = 255").count()
    assert lost == px.where(f"m = 255 and {speck} and x % 32 >= 16").count() > 1000
    label = connect.connect(px.withColumn("m", F.col("m").cast("long")), {"m": connect.component})
    comb = label.where("x % 16 = 0 or y = 0").agg(F.min("m"), F.max("m"), F.count("*")).first()
    assert tuple(comb) == (1, 1, w * h // 16 + w - w // 16)
