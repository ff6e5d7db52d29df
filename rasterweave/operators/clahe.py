"""Contrast-limited adaptive histogram equalisation on pixel tables.

Tiles are a grid of ``grid`` by ``grid``. A tile's histogram is cut at a limit, the
cut part spread evenly (what is left over goes to the lowest values), and its running
share maps values. Each pixel blends the maps of the four nearest tile centres
with integer weights.

A pixel becomes five rows: one counts in its own tile's histogram, four ask their tiles'
maps. All windows are within a frame, so after ``by_frame`` nothing is exchanged or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(p: DataFrame, grid: int) -> DataFrame:
    """From sides _h and _w: tile sides _t, last tiles in use _u, and a pixel's cell _g, the
    tile whose centre is before it, with its distance _r from there."""
    for side, n in (("y", "_h"), ("x", "_w")):
        p = p.withColumn(f"_t{side}", F.expr(f"cast(({n} + {grid - 1}) div {grid} as int)"))
        p = p.withColumn(f"_u{side}", F.expr(f"cast(({n} + _t{side} - 1) div _t{side} - 1 as int)"))  # last tile in use
        # twice the distance to tile centres keeps the weights whole
        p = p.withColumn(f"_g{side}", F.expr(f"cast(floor((2 * {side} + 1 - _t{side}) / (2 * _t{side})) as int)"))
        p = p.withColumn(f"_r{side}", F.expr(f"2 * {side} + 1 - _t{side} - 2 * _t{side} * _g{side}"))
    return p


def share(side: str, d: int) -> str:
    """Weight of the nearer (0) or farther (1) tile of a side."""
    return f"_r{side}" if d else f"(2 * _t{side} - _r{side})"


def mapped(rows: DataFrame, c: str) -> DataFrame:
    """Adds _to, what the map of a row's tile (ty, tx) makes of ``c``; n is how many pixels a row counts, 0 if it only asks."""
    tile = Window.partitionBy("frame_id", "ty", "tx")
    level = Window.partitionBy("frame_id", "ty", "tx", c)
    rows = rows.withColumn("_area", F.sum("n").over(tile)).withColumn("_here", F.sum("n").over(level))
    rows = rows.withColumn("_first", (F.row_number().over(level.orderBy(F.desc("n"))) == 1).cast("int"))
    rows = rows.withColumn("_most", F.greatest(F.lit(1), F.floor(F.col("_area") * F.col("_clip") / 256)))
    rows = rows.withColumn("_cut", F.sum(F.col("_first") * F.greatest(F.lit(0), F.col("_here") - F.col("_most"))).over(tile))
    rows = rows.withColumn("_run", F.sum(F.col("_first") * F.least("_here", "_most")).over(tile.orderBy(c)))
    return rows.withColumn("_to", F.expr(f"(2 * (_run + ({c} + 1) * (_cut div 256) + least({c} + 1, _cut % 256)) * 255 + _area) div (2 * _area)"))


def clahe(px: DataFrame, clip: Column | float, grid: int = 8, c: str = "v") -> DataFrame:
    """``px`` with plane ``c`` equalised; ``clip`` is a number or a column, one value a frame."""
    others = [o for o in px.columns if o not in ("frame_id", "y", "x", c)]
    frame = Window.partitionBy("frame_id")
    p = px.withColumn("_clip", clip if isinstance(clip, Column) else F.lit(float(clip)))
    p = placed(p.withColumn("_h", F.max("y").over(frame) + 1).withColumn("_w", F.max("x").over(frame) + 1), grid)
    place = lambda side, d: F.expr(f"greatest(0, least(_u{side}, _g{side} + {d}))").alias(f"t{side}")
    own = F.struct(F.expr("cast(y div _ty as int)").alias("ty"), F.expr("cast(x div _tx as int)").alias("tx"), F.lit(0).cast("long").alias("w"), F.lit(1).alias("n"))
    corners = [F.struct(place("y", dy), place("x", dx), F.expr(f"cast({share('y', dy)} * {share('x', dx)} as long)").alias("w"), F.lit(0).alias("n")) for dy in (0, 1) for dx in (0, 1)]
    rows = p.select("*", F.inline(F.array(own, *corners)))

    rows = mapped(rows, c)
    rows = rows.withColumn("_to", F.col("w") * F.col("_to"))
    out = rows.groupBy("frame_id", "y", "x").agg(F.sum("_to").alias("_s"), F.first(F.col("_ty").cast("long") * F.col("_tx") * 4).alias("_whole"), *[F.first(o).alias(o) for o in others])
    return out.select("frame_id", "y", "x", *others, F.expr("cast((2 * _s + _whole) div (2 * _whole) as int)").alias(c))


def by_cells(px: DataFrame, clip: Column | float, grid: int = 8, c: str = "v") -> DataFrame:
    """As ``clahe``, for frames that lie in many tasks; ``px`` has their sides as _h and _w.

    Pixels between the same four tile centres are a cell. What is counted and asked for is a cell's values, not its pixels: at most
    256 rows from each quarter of a cell, however large the frame, and no more rows than pixels, however small.
    Pixels join their cell's value by one key."""
    others = [o for o in px.columns if o not in ("frame_id", "y", "x", c, "_h", "_w")]
    p = placed(px.withColumn("_clip", clip if isinstance(clip, Column) else F.lit(float(clip))), grid)
    own = [F.expr(f"cast({side} div _t{side} as int)").alias(f"_o{side}") for side in "yx"]
    values = p.groupBy("frame_id", "_gy", "_gx", *own, c).agg(F.count("*").alias("_n"), *[F.first(k).alias(k) for k in ("_clip", "_uy", "_ux")])
    place = lambda side, d: F.expr(f"greatest(0, least(_u{side}, _g{side} + {d}))").alias(f"t{side}")
    corners = [(dy, dx) for dy in (0, 1) for dx in (0, 1)]
    counts = F.struct(F.col("_oy").alias("ty"), F.col("_ox").alias("tx"), F.col("_n").alias("n"), F.lit(-1).alias("_at"))
    asks = [F.struct(place("y", dy), place("x", dx), F.lit(0).cast("long").alias("n"), F.lit(2 * dy + dx).alias("_at")) for dy, dx in corners]
    rows = mapped(values.select("frame_id", "_gy", "_gx", c, "_clip", F.inline(F.array(counts, *asks))), c).where("_at >= 0")
    maps = rows.groupBy("frame_id", "_gy", "_gx", c).agg(*[F.max(F.when(F.col("_at") == 2 * dy + dx, F.col("_to"))).alias(f"_m{dy}{dx}") for dy, dx in corners])
    total = " + ".join(f"cast({share('y', dy)} * {share('x', dx)} as long) * _m{dy}{dx}" for dy, dx in corners)
    out = p.join(maps, ["frame_id", "_gy", "_gx", c]).withColumn("_s", F.expr(total)).withColumn("_whole", F.expr("cast(_ty as long) * _tx * 4"))
    return out.select("frame_id", "y", "x", *others, F.expr("cast((2 * _s + _whole) div (2 * _whole) as int)").alias(c))
