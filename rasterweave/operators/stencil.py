"""Neighbourhood operators on pixel tables.

All windows are within a frame, so after one exchange on frame_id a chain of stencils
only sorts. Borders repeat the edge pixel. Weights are fixed-point, so results
are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ONE = 65536


def rows():
    """A pixel's row, in order."""
    return Window.partitionBy("frame_id", "y").orderBy("x")


def columns():
    return Window.partitionBy("frame_id", "x").orderBy("y")


#: Pixels of a task. Adaptive planning would join partitions by their compressed bytes, and stages
#: turn a pixel into many rows, so a task's memory would grow with the table.
TASK = 32768


def by_frame(px: DataFrame, pixels: int | None = None) -> DataFrame:
    """The one exchange that a chain of stencils needs; with the number of ``pixels``, tasks are as many as keep their size."""
    if pixels is None:
        return px.repartition("frame_id")
    return px.repartition(max(px.sparkSession.sparkContext.defaultParallelism, -(-pixels // TASK)), "frame_id")


def shifted(c: str, k: int, w) -> Column:
    """Value k further along w; past the edge, the edge's."""
    step = F.lead if k > 0 else F.lag
    return F.coalesce(*[step(c, j).over(w) for j in range(abs(k), 0, -1)], F.col(c)) if k else F.col(c)


def gaussian_weights(radius: int, sigma: float) -> list[int]:
    return [round(ONE * math.exp(-(d * d) / (2 * sigma * sigma))) for d in range(-radius, radius + 1)]


def separable(px: DataFrame, c: str, weights: list[int]) -> DataFrame:
    """Normalised weights along rows, then columns; rounded once, at the end."""
    r = len(weights) // 2
    along = lambda w: sum((shifted(c, k - r, w) * F.lit(weights[k]).cast("long") for k in range(len(weights))), F.lit(0).cast("long"))
    total = sum(weights) ** 2
    out = px.withColumn(c, along(rows())).withColumn(c, along(columns()))
    return out.withColumn(c, F.expr(f"cast(({c} * 2 + {total}) div {2 * total} as int)"))


def gaussian(px: DataFrame, radius: int, sigma: float = 1.0, planes: tuple = ("v",)) -> DataFrame:
    for c in planes:
        px = separable(px, c, gaussian_weights(radius, sigma))
    return px


def box_mean(px: DataFrame, radius: int, planes: tuple = ("r", "g", "b")) -> DataFrame:
    for c in planes:
        px = separable(px, c, [1] * (2 * radius + 1))
    return px


def _line(px: DataFrame, c: str, r: int, w) -> DataFrame:
    """c: array of the 2r + 1 values around along w, the edge's repeated past it."""
    px = px.withColumn("_at", F.row_number().over(w) - 1).withColumn(c, F.collect_list(c).over(w.rowsBetween(-r, r)))
    before, after = F.greatest(F.lit(0), r - F.col("_at")), F.lit(2 * r + 1) - F.size(c) - F.greatest(F.lit(0), r - F.col("_at"))
    return px.withColumn(c, F.concat(F.array_repeat(F.element_at(c, 1), before), c, F.array_repeat(F.element_at(c, -1), after))).drop("_at")


def square(px: DataFrame, planes: tuple, r: int, to: str = "_n") -> DataFrame:
    """to: array of the (2r + 1)^2 neighbours, rows of columns, each a struct of the given planes."""
    px = px.withColumn(to, F.struct(*planes))
    return _line(_line(px, to, r, rows()), to, r, columns()).withColumn(to, F.flatten(to))


def median(px: DataFrame, passes: int = 1, c: str = "v") -> DataFrame:
    for _ in range(passes):
        px = square(px, (c,), 1).withColumn(c, F.element_at(F.array_sort(F.col(f"_n.{c}")), 5)).drop("_n")
    return px


def bilateral_tables(diameter: int, sigma: float, planes: int = 1) -> tuple[list[int], list[int]]:
    """Fixed-point weights of the (2r + 1)^2 places and of the differences, summed over planes."""
    r = diameter // 2
    place = [round(ONE * math.exp(-0.5 * (dx * dx + dy * dy) / sigma**2)) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    return place, [round(ONE * math.exp(-0.5 * (d / sigma) ** 2)) for d in range(255 * planes + 1)]


def bilateral(px: DataFrame, diameter: int, sigma: float, c: str = "v") -> DataFrame:
    """Mean weighted by distance and by difference; products are cut back to the fixed point."""
    return bilateral_rgb(px, diameter, sigma, (c,))


def bilateral_rgb(px: DataFrame, diameter: int, sigma: float, planes: tuple = ("r", "g", "b")) -> DataFrame:
    """As ``bilateral``, for planes weighted by the sum of their differences.

    A pixel's neighbours are rows for a moment, so that weights are plain arithmetic; they are
    summed where they were made, without an exchange."""
    place, range_ = bilateral_tables(diameter, sigma, len(planes))
    others = [o for o in px.columns if o not in ("frame_id", "y", "x", *planes)]
    table = lambda values: f"array({', '.join(map(str, values))})"
    px = square(px, planes, diameter // 2).select("*", F.posexplode("_n").alias("_i", "_q")).drop("_n")
    apart = " + ".join(f"abs(_q.{c} - {c})" for c in planes)
    px = px.withColumn("_w", F.expr(f"cast(element_at({table(place)}, _i + 1) as long) * element_at({table(range_)}, {apart} + 1) div {ONE}"))
    sums = [F.sum(F.col("_w") * F.col(f"_q.{c}")).alias(c) for c in planes]
    px = px.groupBy("frame_id", "y", "x").agg(F.sum("_w").alias("_t"), *sums, *[F.first(o).alias(o) for o in others])
    return px.select("frame_id", "y", "x", *others, *[F.expr(f"cast((2 * {c} + _t) div (2 * _t) as int)").alias(c) for c in planes])


def smooth(px: DataFrame, diameter: int, sigma: float, refine: float, passes: int) -> DataFrame:
    """First pass with sigma, later ones with refine."""
    for k in range(passes):
        px = bilateral(px, diameter, sigma if k == 0 else refine)
    return px


def sobel(px: DataFrame, c: str = "v") -> DataFrame:
    """Adds gx and gy: [1 2 1] across, [-1 0 1] along."""
    px = px.withColumn("_d", shifted(c, 1, rows()) - shifted(c, -1, rows())).withColumn("_s", shifted(c, -1, rows()) + 2 * F.col(c) + shifted(c, 1, rows()))
    gx = shifted("_d", -1, columns()) + 2 * F.col("_d") + shifted("_d", 1, columns())
    gy = shifted("_s", 1, columns()) - shifted("_s", -1, columns())
    return px.withColumn("gx", gx.cast("int")).withColumn("gy", gy.cast("int")).drop("_d", "_s")


def magnitude(norm: str = "l1") -> Column:
    """L1, or for L2 the square, which orders alike."""
    return F.abs("gx") + F.abs("gy") if norm == "l1" else F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")


def direction() -> Column:
    """0 along x, 1 along the falling diagonal, 2 along y, 3 along the rising one;
    bins meet at 22.5 degrees, compared in integers (tan 22.5 = 0.4142)."""
    ax, ay = F.abs("gx"), F.abs("gy")
    return F.when(ay * 10000 <= ax * 4142, 0).when(ax * 10000 <= ay * 4142, 2).when((F.col("gx") > 0) == (F.col("gy") > 0), 1).otherwise(3)


def suppress(px: DataFrame, mag: str = "mag", dir_: str = "dir", as_written: bool = False) -> DataFrame:
    """Keeps a magnitude that is at least both neighbours along its direction.
    ``as_written`` swaps the diagonals."""
    px = px.withColumn("_l", shifted(mag, -1, rows())).withColumn("_r", shifted(mag, 1, rows()))
    at = {"l": F.col("_l"), "r": F.col("_r"), "u": shifted(mag, -1, columns()), "d": shifted(mag, 1, columns()), "ul": shifted("_l", -1, columns()), "dr": shifted("_r", 1, columns()), "ur": shifted("_r", -1, columns()), "dl": shifted("_l", 1, columns())}
    for k, v in at.items():
        px = px.withColumn(f"_{k}2", v)
    one, three = (("ur", "dl"), ("ul", "dr")) if as_written else (("ul", "dr"), ("ur", "dl"))
    sides = [("l", "r"), one, ("u", "d"), three]
    keep = F.lit(False)
    for k, (a, b) in enumerate(sides):
        keep = keep | ((F.col(dir_) == k) & (F.col(mag) >= F.col(f"_{a}2")) & (F.col(mag) >= F.col(f"_{b}2")))
    return px.withColumn("nms", F.when(keep, F.col(mag)).otherwise(0)).drop("_l", "_r", *[f"_{k}2" for k in at])


def threshold(value: Column, low, high) -> Column:
    return F.when(value >= high, 2).when(value >= low, 1).otherwise(0)


def extreme(px: DataFrame, c: str, rx: int, ry: int, largest: bool) -> DataFrame:
    """Max or min over a (2rx + 1) x (2ry + 1) rectangle."""
    f = F.max if largest else F.min
    px = px.withColumn(c, f(c).over(rows().rowsBetween(-rx, rx)))
    return px.withColumn(c, f(c).over(columns().rowsBetween(-ry, ry)))


def disc(px: DataFrame, c: str, r: int, largest: bool) -> DataFrame:
    """Max or min over dx^2 + dy^2 <= r^2: one row window for each dy."""
    f, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    widths = {dy: math.isqrt(r * r - dy * dy) for dy in range(r + 1)}
    for dy, h in widths.items():
        px = px.withColumn(f"_m{dy}", f(c).over(rows().rowsBetween(-h, h)))
    # max and min are the same over a clamped border as over a cut one
    lines = [F.col("_m0")] + [shifted(f"_m{dy}", s * dy, columns()) for dy in range(1, r + 1) for s in (-1, 1)]
    return px.withColumn(c, pick(*lines) if len(lines) > 1 else lines[0]).drop(*[f"_m{dy}" for dy in widths])


def close(px: DataFrame, c: str = "m", r: int = 1) -> DataFrame:
    return extreme(extreme(px, c, r, r, True), c, r, r, False)


def open_disc(px: DataFrame, c: str = "m", r: int = 1) -> DataFrame:
    return disc(disc(px, c, r, False), c, r, True)


def merge_double_edge(px: DataFrame, intensity: int | None, c: str = "m") -> DataFrame:
    """Close with size 3 + 2i, then one 3 x 3 erosion."""
    i = max(1, min(5, intensity or 2))
    return extreme(close(px, c, 1 + i), c, 1, 1, False)


def line_weight(px: DataFrame, weight: int, c: str = "m") -> DataFrame:
    return disc(px, c, weight - 1, True) if weight > 1 else px


def hysteresis_once(px: DataFrame, c: str = "state") -> DataFrame:
    """Weak pixels with a strong 8-neighbour become strong, other weak ones none."""
    px = px.withColumn("_m", F.max(c).over(rows().rowsBetween(-1, 1))).withColumn("_m", F.max("_m").over(columns().rowsBetween(-1, 1)))
    return px.withColumn(c, F.when((F.col(c) >= 1) & (F.col("_m") == 2), 2).otherwise(0)).drop("_m")
