"""Per-pixel projections and per-frame statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame():
    """All pixels of a frame."""
    return Window.partitionBy("frame_id")


def clamp(lo, hi, x: Column) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def luma(r="r", g="g", b="b") -> Column:
    """0.299 r + 0.587 g + 0.114 b, rounded, in integers."""
    return F.expr(f"cast((299 * {r} + 587 * {g} + 114 * {b} + 500) div 1000 as int)")


def pack(r="r", g="g", b="b") -> Column:
    """0xffBBGGRR as a BIGINT."""
    shift = lambda c, k: F.shiftleft(F.col(c).cast("long"), k)
    return F.lit(255 << 24).cast("long").bitwiseOR(shift(b, 16)).bitwiseOR(shift(g, 8)).bitwiseOR(F.col(r).cast("long"))


def unpack(c: str) -> list[Column]:
    return [F.shiftright(c, k).bitwiseAND(F.lit(255).cast("long")).cast("int").alias(n) for n, k in (("r", 0), ("g", 8), ("b", 16), ("a", 24))]


def frame_stats(px: DataFrame, c: str = "v") -> DataFrame:
    """(frame_id, n, total, squares, lo, hi, mean, std) with exact integer sums."""
    s = px.groupBy("frame_id").agg(F.count(c).alias("n"), F.sum(F.col(c).cast("long")).alias("total"), F.sum(F.col(c).cast("long") * F.col(c)).alias("squares"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    return s.withColumn("mean", F.col("total") / F.col("n")).withColumn("std", F.sqrt((F.col("n") * F.col("squares") - F.col("total") * F.col("total")).cast("double")) / F.col("n"))


def gamma(mean: Column) -> Column:
    return clamp(1.5, 3.0, 1.0 + (80 - mean) / 40)


def gamma_lift(px: DataFrame, c: str = "v", mean: str = "mean") -> DataFrame:
    """Brightens frames with a mean below 80."""
    lifted = F.floor(F.pow(F.col(c) / 255, 1 / gamma(F.col(mean))) * 255 + 0.5).cast("int")
    return px.withColumn(c, F.when(F.col(mean) < 80, lifted).otherwise(F.col(c)))


def stretched(c: str, lo: str, hi: str, std: str | None) -> Column:
    """lo..hi to 0..255 where std is below 45 (everywhere without ``std``) and lo differs from hi."""
    out = F.expr(f"cast((2 * ({c} - {lo}) * 255 + ({hi} - {lo})) div (2 * ({hi} - {lo})) as int)")
    when = F.col(hi) > F.col(lo)
    return F.when(when & (F.col(std) < 45) if std else when, out).otherwise(F.col(c))


def stretch(px: DataFrame, c: str = "v", std: str | None = "std") -> DataFrame:
    """Min-max to 0..255 for frames with a deviation below 45 (all without ``std``);
    constant frames stay."""
    px = px.withColumn("_lo", F.min(c).over(frame())).withColumn("_hi", F.max(c).over(frame()))
    return px.withColumn(c, stretched(c, "_lo", "_hi", std)).drop("_lo", "_hi")


def rgb_literal(c: tuple) -> Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "rgb")])


def colorize(px: DataFrame, background: tuple, ink: tuple, edge: Column, color_edge: Column | None = None, opacity: float = 1.0, truncate: bool = True) -> DataFrame:
    """(frame_id, y, x, r, g, b): ink on edges, the pixel's paint on colour edges,
    else background. Blends truncate, or round."""
    planes = []
    for k, c in enumerate("rgb"):
        value = F.lit(background[k])
        if color_edge is not None:
            paint = F.col(c)
            if opacity < 1:
                mixed = background[k] * (1 - opacity) + paint * opacity
                paint = F.floor(mixed if truncate else mixed + 0.5).cast("int")
            value = F.when(color_edge, paint).otherwise(value)
        planes.append(F.when(edge, ink[k]).otherwise(value).cast("int").alias(c))
    return px.select("frame_id", "y", "x", *planes)


def resample(px: DataFrame, scale: float, columns: tuple = ("v",)) -> DataFrame:
    """Frames at ``scale`` <= 1: each target pixel is the mean of the source area under it, so the frame's mean is kept.

    Sides are rounded, at least 1. In units of 1 / (source side * target side) all edges are whole numbers: a source
    pixel lies under at most two targets a side, its overlaps are exact weights, and values are rounded once."""
    out = px
    targets = []
    for c, n in (("y", "_h"), ("x", "_w")):
        out = out.withColumn(n, (F.max(c).over(frame()) + 1).cast("long")).withColumn(f"_t{n[1]}", F.greatest(F.lit(1), F.floor(F.col(n) * scale + 0.5)).cast("long"))
        t, m = F.col(f"_t{n[1]}"), F.col(n)
        first = F.expr(f"{c} * _t{n[1]} div {n}")
        under = lambda k: F.struct(k.cast("int").alias("at"), (F.least((F.col(c) + 1) * t, (k + 1) * m) - F.greatest(F.col(c) * t, k * m)).alias("part"))  # noqa: B023, E731
        targets.append(F.filter(F.array(under(first), under(first + 1)), lambda o: o["part"] > 0))
    keep = ["frame_id", "_h", "_w", *columns]
    out = out.select(*keep, targets[0].alias("_y"), targets[1].alias("_x")).select(*keep, F.explode("_y").alias("_y"), "_x").select(*keep, "_y", F.explode("_x").alias("_x"))
    weight = F.col("_y.part") * F.col("_x.part")
    sums = [F.sum(F.col(c) * weight).alias(c) for c in columns]
    g = out.groupBy("frame_id", F.col("_y.at").alias("y"), F.col("_x.at").alias("x")).agg(F.first(F.col("_h") * F.col("_w")).alias("_n"), *sums)
    return g.select("frame_id", "y", "x", *[F.expr(f"cast((2 * {c} + _n) div (2 * _n) as int)").alias(c) for c in columns])
