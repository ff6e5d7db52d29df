"""Pixel operators against NumPy on whole frames, properties, and edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from pyspark.sql import functions as F

from rasterweave.operators import clahe, connect, lineart, point, stencil, tiling
from rasterweave.plans import model

import reference_frames as frames

SHAPES = {
    "one": np.array([[7]]),
    "row": np.arange(9).reshape(1, 9) * 20,
    "column": np.arange(9).reshape(9, 1) * 20,
    "constant": np.full((6, 5), 90),
    "black": np.zeros((5, 5), int),
    "white": np.full((5, 5), 255),
    "board": (np.indices((8, 8)).sum(0) % 2) * 255,
    "dot": np.pad([[255]], 4),
    "diagonal": np.eye(9, dtype=int) * 255,
    "noise": np.random.default_rng(4).integers(0, 256, (13, 11)),
}


def pixels(spark, arrays, c="v"):
    rows = [(k, y, x, int(a[y, x])) for k, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, f"frame_id long, y int, x int, {c} int")


def arrays(df, like, c="v"):
    out = [np.zeros_like(a) for a in like]
    for r in df.select("frame_id", "y", "x", c).collect():
        out[r.frame_id][r.y, r.x] = r[c]
    return out


STENCILS = {
    "gaussian": (lambda p: stencil.gaussian(p, 2, 1.1), lambda a: frames.gaussian(a, 2, 1.1)),
    "median": (stencil.median, frames.median),
    "bilateral": (lambda p: stencil.bilateral(p, 5, 30), lambda a: frames.bilateral(a, 5, 30)),
    "box": (lambda p: stencil.box_mean(p, 1, ("v",)), lambda a: frames.separable(a, [1, 1, 1])),
    "dilate": (lambda p: stencil.disc(p, "v", 3, True), lambda a: frames.dilate_disc(a, 3)),
    "close": (lambda p: stencil.close(p, "v", 2), lambda a: frames.close(a, 2)),
    "stretch": (lambda p: point.stretch(p, "v", None), frames.stretch),
}


@pytest.mark.parametrize("name", STENCILS)
def test_tiers_agree(spark, name):
    px, fr = STENCILS[name]
    want = list(SHAPES.values())
    for a, got in zip(want, arrays(px(pixels(spark, want)), want)):
        assert (fr(a) == got).all()


def test_colour_bilateral_agrees(spark):
    a = np.random.default_rng(8).integers(0, 256, (7, 9, 3))
    rows = [(0, y, x, *map(int, a[y, x])) for y in range(7) for x in range(9)]
    px = stencil.bilateral_rgb(spark.createDataFrame(rows, "frame_id long, y int, x int, r int, g int, b int"), 5, 60)
    got = np.zeros_like(a)
    for r in px.collect():
        got[r.y, r.x] = (r.r, r.g, r.b)
    assert (frames.bilateral_rgb(a, 5, 60) == got).all()


def test_edges_agree(spark):
    like = list(SHAPES.values())
    px = stencil.sobel(pixels(spark, like)).withColumn("mag", stencil.magnitude("l2")).withColumn("dir", stencil.direction())
    px = stencil.suppress(px)
    for a, got in zip(like, arrays(px, like, "nms")):
        gx, gy = frames.sobel(a)
        assert (frames.suppress(gx * gx + gy * gy, gx, gy) == got).all()


def test_clahe_agrees(spark):
    like = [np.random.default_rng(1).integers(0, 256, shape) for shape in ((16, 24), (13, 11), (1, 1), (3, 40), (9, 1))]
    for a, got in zip(like, arrays(clahe.clahe(pixels(spark, like), 40.0), like)):
        assert (frames.clahe(a, 40.0) == got).all(), a.shape


def test_tiles_with_halo_agree(spark):
    a = np.random.default_rng(2).integers(0, 256, (20, 30))
    px = tiling.tiled(pixels(spark, [a]), 7, 3, 30, 20)
    px = tiling.untiled(stencil.median(stencil.gaussian(px, 2, 1.1)), 7)
    assert (arrays(px, [a])[0] == frames.median(frames.gaussian(a, 2, 1.1))).all()


def components(mask):
    """Brute force flood fill."""
    seen, out = set(), []
    for p in zip(*np.nonzero(mask)):
        if p in seen:
            continue
        todo, group = [p], set()
        while todo:
            y, x = todo.pop()
            if (y, x) in group or not (0 <= y < mask.shape[0] and 0 <= x < mask.shape[1]) or not mask[y, x]:
                continue
            group.add((y, x))
            todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        seen |= group
        out.append(group)
    return out


@settings(max_examples=60, deadline=None)
@given(hnp.arrays(np.int64, st.tuples(st.integers(1, 12), st.integers(1, 12)), elements=st.integers(0, 1)))
def test_labels_are_components(mask):
    h, w = mask.shape
    lab = connect.component(mask.ravel(), np.array([w]), np.array([h])).reshape(h, w)
    assert (lab == frames.label(mask > 0)).all()
    groups = {frozenset(zip(*(i.tolist() for i in np.nonzero(lab == k)))) for k in np.unique(lab) if k}
    assert groups == {frozenset((int(y), int(x)) for y, x in g) for g in components(mask)}


@pytest.mark.parametrize(("intensity", "area"), model.MIN_AREA.items())
def test_speckles_at_the_threshold(intensity, area):
    for n, kept in ((area - 1, 0), (area, n_kept := area)):
        m = np.zeros((3, 80), int)
        m[1, 1 : 1 + n] = 255
        got = connect.without_specks(area)(m.ravel(), np.array([80]), np.array([3]))
        assert (got.reshape(m.shape) == frames.clean_speckles(m, intensity)).all()
        assert (got > 0).sum() == (n_kept if n >= area else kept)


@settings(max_examples=40, deadline=None)
@given(hnp.arrays(np.int64, (9, 9), elements=st.sampled_from([0, 255])))
def test_morphology_properties(m):
    assert (frames.dilate_disc(m, 1) >= m).all()
    assert (frames.extreme(m, 1, False) <= m).all()
    once = frames.close(m)
    assert (frames.close(once) == once).all()
    assert (frames.clean_speckles(m, 3) <= frames.clean_speckles(m, 1)).all()


@settings(max_examples=40, deadline=None)
@given(hnp.arrays(np.int64, (8, 8), elements=st.integers(0, 2)))
def test_one_hop_within_closure(s):
    grown = connect.closure(s.ravel(), np.array([8]), np.array([8])).reshape(8, 8) > 0
    assert (grown == frames.hysteresis(s == 2, s >= 1)).all()
    one = np.where((s >= 1) & (frames.extreme(s, 1, True) == 2), 2, 0)
    assert (grown | (one == 0)).all()
    assert (grown <= (s >= 1)).all()


def test_gamma_and_stretch_borders(spark):
    for mean, lifted in ((79, True), (80, False), (81, False)):
        px = pixels(spark, [np.full((2, 2), mean)]).withColumn("mean", F.avg("v").over(point.frame()))
        got = point.gamma_lift(px).first().v
        assert (got > mean) == lifted


RENDERS = {
    "manga": model.Settings(),
    "blueprint": model.Settings(preset=model.preset("blueprint"), line_weight=3),
    "custom": model.Settings(preset=model.preset("custom", diameter=5), custom=True, gaussian=True, median=True, dark_boost=True, color_edges=True, color_softness=1, color_line_weight=2, color_opacity=0.4),
}


@pytest.mark.parametrize("name", RENDERS)
def test_renders_of_mixed_sizes_equal_whole_frames(spark, name):
    rng = np.random.default_rng(9)
    like = [rng.integers(0, 256, shape) for shape in ((17, 24, 3), (1, 1, 3), (5, 1, 3))] + [rng.integers(0, 60, (12, 9, 3))]
    rows = [(k, y, x, *map(int, a[y, x])) for k, a in enumerate(like) for y in range(a.shape[0]) for x in range(a.shape[1])]
    out = lineart.line_art(spark.createDataFrame(rows, "frame_id long, y int, x int, r int, g int, b int"), RENDERS[name])
    got = [np.zeros_like(a) for a in like]
    for r in out.collect():
        got[r.frame_id][r.y, r.x] = (r.r, r.g, r.b)
    for a, b in zip(like, got):
        assert (frames.line_art(a.astype(np.uint8), RENDERS[name]) == b).all(), a.shape


def test_custom_preset():
    assert model.preset("custom").low == 40 and model.preset("custom", low=7).low == 7 and set(model.LABELS) == {*model.NAMES, "custom"}
    with pytest.raises(ValueError):
        model.preset("none")


def test_components_of_a_large_frame():
    """A 1080p spiral-like comb is one component; labelling takes few rounds."""
    m = np.zeros((1080, 1920), np.int64)
    m[:, ::4] = 1
    m[0, 2::8] = m[0, 1::8] = m[0, 3::8] = m[-1, 6::8] = m[-1, 5::8] = m[-1, 7::8] = 1
    lab = connect.component(m.ravel(), np.array([1920]), np.array([1080]))
    assert set(lab[m.ravel() > 0]) == {1}


def test_presets_at_standard_detail():
    got = {k: model.Settings(preset=model.preset(k)).derived() for k in model.NAMES}
    assert got["manga"] == {"low": 28, "high": 96, "sigma": 73, "refine": 37}
    assert got["vivid"] == {"low": 18, "high": 66, "sigma": 98, "refine": 49}
    assert got["blueprint"] == {"low": 48, "high": 144, "sigma": 45, "refine": 23}
