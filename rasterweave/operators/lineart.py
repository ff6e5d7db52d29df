"""Line-art renders composed of the pixel operators, in their canonical order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.operators import connect, point, stencil
from rasterweave.operators.tiling import Frames, Tiles
from rasterweave.plans.model import MIN_AREA, Settings

RGB, SMOOTH = ("r", "g", "b"), ("_sr", "_sg", "_sb")


def softness(s: Settings) -> tuple[int, float]:
    """Radius and sigma of the colour path's blur."""
    return s.color_softness, 0.3 * (s.color_softness - 1) + 0.8


def smoothing(s: Settings) -> list[float]:
    """Sigma of each bilateral pass."""
    d = s.derived()
    passes = (max(1, min(5, s.bilateral_passes or 2)) if s.bilateral else 0) if s.custom else (3 if s.preset.passes >= 2 else 1)
    return [d["sigma"] if k == 0 else d["refine"] for k in range(passes)]


def states(px: DataFrame, source: str, low: int, high: int, out: str) -> DataFrame:
    """Canny up to the double threshold, by squared magnitudes."""
    px = stencil.sobel(px, source).withColumn("_mag", stencil.magnitude("l2")).withColumn("_dir", stencil.direction())
    px = stencil.suppress(px, "_mag", "_dir")
    return px.withColumn(out, stencil.threshold(F.col("nms"), low * low, high * high)).drop("gx", "gy", "_mag", "_dir", "nms")


def line_art(px: DataFrame, s: Settings, tile: int | None = None, pixels: int | None = None) -> DataFrame:
    """(frame_id, y, x, r, g, b) -> the same, rendered. Optional stages are chosen when the plan is made.

    Without ``tile`` a frame is one task: one exchange on frame_id serves all stages up to the edges, one more follows
    each step of connectivity. With it frames are cut into tiles of that side, with a halo as wide as the radii of
    the stages before the next fact about the whole frame; results are the same. Frames of any sizes may be mixed.
    With the number of ``pixels``, tasks are as many as keep their size.
    """
    on = Tiles(tile, pixels) if tile else Frames()
    colour, normal = s.custom and s.color_edges, s.auto_normalize or not s.custom
    d, p = s.derived(), s.preset
    keep = ["frame_id", "y", "x", *(RGB if colour else ())]
    sigmas = smoothing(s)
    blurs = max(1, min(5, s.gaussian_passes or 1)) if s.custom and s.gaussian else 0
    medians = max(1, min(3, s.median_passes or 1)) if s.custom and s.median else 0

    def smoothed(px):
        for c, to in zip(RGB, SMOOTH):
            px = px.withColumn(to, F.col(c))
        for sigma in sigmas:
            px = stencil.bilateral_rgb(px, p.diameter, sigma, SMOOTH)
        px = px.withColumn("v", point.luma(*SMOOTH)).select(*keep, "raw", "v")
        for _ in range(blurs):
            px = stencil.gaussian(px, 2, 1.1)
        return stencil.median(px, medians)

    px = px.select("frame_id", "y", "x", *RGB)
    px = (px if tile else stencil.by_frame(px, pixels)).withColumn("raw", point.luma())
    px = on.local(px, len(sigmas) * (p.diameter // 2) + 2 * blurs + medians, smoothed)
    if normal:
        raw = F.col("raw").cast("long")
        px = on.facts(px, _n=F.count("raw"), _total=F.sum(raw), _squares=F.sum(raw * raw), _lo=F.min("v"), _hi=F.max("v"))
        px = px.withColumn("_mean", F.expr("_total / _n")).withColumn("_std", F.sqrt(F.expr("cast(_n * _squares - _total * _total as double)")) / F.col("_n"))
        for c in ("raw", "v", "_lo", "_hi"):  # brightening keeps the order, so the least stays the least
            px = point.gamma_lift(px, c, "_mean")
        px = px.withColumn("v", point.stretched("v", "_lo", "_hi", "_std")).drop("_n", "_total", "_squares", "_lo", "_hi")
        px = on.clahe(px, point.clamp(1.5, 4.5, 150 / F.greatest(F.col("_mean"), F.lit(1.0))))
    edges = lambda px: states(px, "v", d["low"], d["high"], "m")
    if s.custom and s.dark_boost:
        px = on.local(px, 2, lambda px: stencil.gaussian(px, 2, 1.1))
        px = on.local(on.clahe(px, max(1.0, min(6.0, s.dark_boost_clip or 2.5))), 2, edges)
    else:
        px = on.local(px, 4, lambda px: edges(stencil.gaussian(px, 2, 1.1)))
    planes = {"m": connect.closure}
    if colour:
        if s.color_softness:
            px = on.local(px, s.color_softness, lambda px: stencil.gaussian(px, *softness(s), ("raw", *RGB)))
            px = on.facts(px, _lo=F.min("raw"), _hi=F.max("raw"))
            px = px.withColumn("raw", point.stretched("raw", "_lo", "_hi", None)).drop("_lo", "_hi")
        px = on.local(px, 2, lambda px: states(px, "raw", s.color_low, s.color_high, "cm"))
        planes["cm"] = connect.closure
        if normal:
            for c in RGB:
                px = point.gamma_lift(px, c, "_mean")
        keep.append("cm")
    px = connect.connect(px.select(*keep, "m"), planes, tile or connect.TILE)
    px = on.local(px if tile else stencil.by_frame(px, pixels), 2, stencil.close)
    if s.custom and s.clean_speckles:
        px = connect.connect(px, {"m": connect.without_specks(MIN_AREA[s.clean_intensity])}, tile or connect.TILE)
        px = px if tile else stencil.by_frame(px, pixels)
    merged = max(1, min(5, s.merge_intensity or 2)) if s.custom and s.merge_double_edge else 0

    def drawn(px):
        if merged:
            px = stencil.merge_double_edge(px, s.merge_intensity)
        px = stencil.line_weight(px, s.line_weight)
        return stencil.line_weight(px, s.color_line_weight, "cm") if colour else px

    px = on.local(px, max((2 * (1 + merged) + 1 if merged else 0) + s.line_weight - 1, s.color_line_weight - 1 if colour else 0), drawn)
    lines = F.col("cm") > 127 if colour else None
    return point.colorize(px, p.background, p.ink, F.col("m") > 127, lines, s.color_opacity)
