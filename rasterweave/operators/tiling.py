"""Tiles with a halo, so that few large frames still use many tasks.

A tile holds its pixels and those within ``halo`` around it; stencils whose radii add
up to at most the halo give the same values inside the tile as on the whole frame.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.operators import clahe, stencil
from rasterweave.sources.session import written


def tiled(px: DataFrame, size: int, halo: int, width: int, height: int) -> DataFrame:
    """frame_id becomes the tile's key; _frame, _ty and _tx name the tile."""
    across, down = -(-width // size), -(-height // size)
    span = lambda c, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / size)), F.least(F.lit(n - 1), F.floor((F.col(c) + halo) / size)))
    t = px.withColumn("_ty", F.explode(span("y", down))).withColumn("_tx", F.explode(span("x", across))).withColumn("_frame", F.col("frame_id"))
    return t.withColumn("frame_id", F.col("_frame") * (across * down) + F.col("_ty") * across + F.col("_tx"))


def untiled(px: DataFrame, size: int) -> DataFrame:
    """Each tile's own pixels with their frame."""
    own = px.where(f"y div {size} = _ty and x div {size} = _tx").withColumn("frame_id", F.col("_frame"))
    return own.drop("_frame", "_ty", "_tx")


def cut(px: DataFrame, size: int, halo: int) -> DataFrame:
    """As ``tiled`` for frames of any sizes: frame_id becomes a struct of the frame and the tile's place."""
    span = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / size)), F.floor((F.col(c) + halo) / size))
    t = px.withColumn("_ty", F.explode(span("y"))).withColumn("_tx", F.explode(span("x")))
    return t.withColumn("frame_id", F.struct(F.col("frame_id").alias("of"), F.col("_ty").alias("ty"), F.col("_tx").alias("tx"))).drop("_ty", "_tx")


def whole(px: DataFrame, size: int) -> DataFrame:
    """Each tile's own pixels of ``cut`` with their frame; tiles that only a halo reaches go."""
    return px.where(f"y div {size} = frame_id.ty and x div {size} = frame_id.tx").withColumn("frame_id", F.col("frame_id.of"))


class Frames:
    """Where a render's stages run: on whole frames, each in one task, so a chain of stages costs one exchange."""

    def local(self, px: DataFrame, radius: int, stage) -> DataFrame:
        """``stage`` of pixels that look at most ``radius`` around them."""
        return stage(px)

    def facts(self, px: DataFrame, **aggregates) -> DataFrame:
        """``px`` with columns that are one value a frame."""
        for name, value in aggregates.items():
            px = px.withColumn(name, value.over(Window.partitionBy("frame_id")))
        return px

    def clahe(self, px: DataFrame, clip, c: str = "v") -> DataFrame:
        return clahe.clahe(px, clip, c=c)


class Tiles(Frames):
    """On tiles of ``size`` with a halo as wide as the radii of the stages between two
    facts of the whole frame add up to. Facts are aggregated first and joined to the tiles; what is read for both is written."""

    def __init__(self, size: int, pixels: int | None = None):
        self.size, self.pixels = size, pixels

    def local(self, px: DataFrame, radius: int, stage) -> DataFrame:
        if not radius:
            return stage(px)
        wide = self.size + 2 * radius
        pixels = None if self.pixels is None else self.pixels * wide**2 // self.size**2
        return whole(stage(stencil.by_frame(cut(px, self.size, radius), pixels)), self.size)

    def facts(self, px: DataFrame, **aggregates) -> DataFrame:
        px = written(px, "stage")
        return px.join(px.groupBy("frame_id").agg(*[v.alias(n) for n, v in aggregates.items()]), "frame_id")

    def clahe(self, px: DataFrame, clip, c: str = "v") -> DataFrame:
        return clahe.by_cells(self.facts(px, _h=F.max("y") + 1, _w=F.max("x") + 1), clip, c=c)
