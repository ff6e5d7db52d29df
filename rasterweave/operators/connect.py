"""Connectivity, the one iterative part, on tiles of frames of any size.

A frame is cut into tiles; a tile is packed to one row and labelled there, a batch of rows at once.
Labels come from hooking roots to smaller ones and shortening paths, so rounds grow with the
logarithm of a component's size. Where a frame has more than one tile, only the pixels on tile borders
leave their tiles: those that touch across a border are edges between labels, which ``graph.contract``
joins in distributed rounds, and what the joined components are goes back to the tiles that have a part
of them. So no task holds more than a batch of tiles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.operators import graph
from rasterweave.sources.session import ship, written

#: Side of a tile.
TILE = 256
#: A pixel's place in row-major order, whatever the frame's width.
PLACE = 32
BORDERS = "plane int, frame_id long, y int, x int, label long, area long, strong boolean"
MERGED = "array<struct<plane:int,label:bigint,root:bigint,area:bigint,strong:boolean>>"


@dataclass(frozen=True)
class Rule:
    """What of a plane is on (from ``on``), what is strong, and what becomes of it:
    ``out(plane, on, first, area, strong)``, all by pixel, where first is 1 + the row-major place in
    the frame of its component's first pixel, area the component's pixels, strong whether it has a strong one."""

    on: int
    strong: int
    out: Callable

    def __call__(self, plane: np.ndarray, widths: np.ndarray, heights: np.ndarray) -> np.ndarray:
        """For whole frames laid end to end."""
        on, label, area, strong = self.local(plane, widths, heights)
        first = np.repeat(np.cumsum(widths * heights) - widths * heights, widths * heights)
        return self.out(plane, on, label - first + 1, area[label], strong[label])

    def local(self, plane, widths, heights):
        """(on, label, and by label area and strong)."""
        on = plane >= self.on
        label = labels(on, widths, heights)
        strong = np.zeros(len(plane), bool)
        strong[label[on & (plane >= self.strong)]] = True
        return on, label, np.bincount(label[on], minlength=len(plane)), strong


#: 255 where a strong pixel (2) is or a weak one (1) reaches one, else 0.
closure = Rule(1, 2, lambda plane, on, first, area, strong: np.where(on & strong, 255, 0))
#: 1 + the row-major place in the frame of the component's first pixel, 0 off.
component = Rule(1, 1, lambda plane, on, first, area, strong: np.where(on, first, 0))


def without_specks(least: int) -> Rule:
    """Components of fewer than ``least`` pixels go."""
    return Rule(1, 1, lambda plane, on, first, area, strong: np.where(on & (area >= least), plane, 0))


def pack(px: DataFrame, size: int = TILE) -> DataFrame:
    """(frame_id, ty, tx, width, height, one array a column in row-major order) of each tile; frames are complete rectangles."""
    columns = [c for c in px.columns if c not in ("frame_id", "y", "x")]
    tile = [F.expr(f"cast({c} div {size} as int)").alias(f"t{c}") for c in ("y", "x")]
    side = lambda c, n: (F.max(c) + 1 - F.first(F.expr(f"{c} div {size} * {size}"))).cast("int").alias(n)
    g = px.groupBy("frame_id", *tile).agg(side("x", "width"), side("y", "height"), F.array_sort(F.collect_list(F.struct("y", "x", *columns))).alias("p"))
    return g.select("frame_id", "ty", "tx", "width", "height", *[F.col(f"p.{c}").alias(c) for c in columns])


def unpack(tiles: DataFrame, size: int = TILE) -> DataFrame:
    columns = [c for c in tiles.columns if c not in ("frame_id", "ty", "tx", "width", "height")]
    p = tiles.select("frame_id", "ty", "tx", "width", F.posexplode(F.arrays_zip(*columns)).alias("p", "c"))
    return p.select("frame_id", F.expr(f"cast(ty * {size} + p div width as int)").alias("y"), F.expr(f"cast(tx * {size} + p % width as int)").alias("x"), *[f"c.{c}" for c in columns])


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the edges (u, v)."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def labels(on: np.ndarray, widths: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """For frames laid end to end: the first pixel of each pixel's 8-connected component
    of ``on`` pixels, as a place in the whole; pixels that are off keep their own."""
    starts = np.cumsum(widths * heights) - widths * heights
    us, vs = [], []
    for w, h in {*zip(widths.tolist(), heights.tolist())}:
        own = starts[(widths == w) & (heights == h)]
        at = own[:, None, None] + np.arange(h * w).reshape(h, w)
        m = on[at]
        for a, b in ((np.s_[:, :, :-1], np.s_[:, :, 1:]), (np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:, :-1, :-1], np.s_[:, 1:, 1:]), (np.s_[:, :-1, 1:], np.s_[:, 1:, :-1])):
            both = m[a] & m[b]
            us.append(at[a][both])
            vs.append(at[b][both])
    return roots(len(on), np.concatenate(us), np.concatenate(vs)) if us else np.arange(len(on))


class Batch:
    """The tiles of an Arrow batch laid end to end."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        self.batch = batch
        self.frames, ty, tx, self.w, self.h = (batch.column(c).to_numpy().astype(np.int64) for c in ("frame_id", "ty", "tx", "width", "height"))
        self.top, self.left = ty * size, tx * size
        area = self.w * self.h
        self.starts = np.cumsum(area) - area
        self.tile = np.repeat(np.arange(len(area)), area)

    def plane(self, c: str) -> np.ndarray:
        return self.batch.column(c).flatten().to_numpy(zero_copy_only=False)

    def at(self, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(y, x) in their frames."""
        t = self.tile[pixels]
        p = pixels - self.starts[t]
        return self.top[t] + p // self.w[t], self.left[t] + p % self.w[t]

    def with_planes(self, made: dict[str, np.ndarray]) -> pa.RecordBatch:
        out = self.batch
        offsets = pa.array(np.append(self.starts, len(self.tile)).astype(np.int32))
        for c, values in made.items():
            k = out.schema.get_field_index(c)
            kind = out.column(k).type
            out = out.set_column(k, out.schema.field(k), pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int64))).cast(kind))
        return out


def border_pixels(planes: dict[str, Rule], size: int):
    """On pixels at the edges of tiles, with what their component is inside the tile."""

    def run(batches):
        for raw in batches:
            b = Batch(raw, size)
            for k, (c, rule) in enumerate(planes.items()):
                on, label, area, strong = rule.local(b.plane(c), b.w, b.h)
                p = np.arange(len(on)) - b.starts[b.tile]
                y, x = p // b.w[b.tile], p % b.w[b.tile]
                edge = np.flatnonzero(on & ((y == 0) | (x == 0) | (y == b.h[b.tile] - 1) | (x == b.w[b.tile] - 1)))
                (y, x), (ly, lx), own = b.at(edge), b.at(label[edge]), label[edge]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (np.full(len(edge), k, np.int32), b.frames[b.tile[edge]], y.astype(np.int32), x.astype(np.int32), (ly << PLACE) + lx, area[own], strong[own])],
                    ["plane", "frame_id", "y", "x", "label", "area", "strong"],
                )

    return run


def merged_labels(borders: DataFrame, size: int) -> DataFrame:
    """(frame_id, ty, tx, merged): of each tile the labels at its edges with the whole components they belong to."""
    keys = ["plane", "frame_id"]
    # a neighbour to the right or below, in another tile
    beside = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))]))
    asks = borders.select(*keys, F.col("label").alias("u"), F.expr(f"y div {size}").alias("ty"), F.expr(f"x div {size}").alias("tx"), beside.alias("n"))
    asks = asks.where(f"n.y div {size} <> ty or n.x div {size} <> tx").select(*keys, "u", "n.y", "n.x")
    edges = asks.join(borders.select(*keys, "y", "x", F.col("label").alias("v")), [*keys, "y", "x"]).select(*keys, "u", "v")
    joined = graph.contract(edges, keys)
    own = borders.select(*keys, "label", "area", "strong").distinct()
    own = own.join(joined.withColumnRenamed("node", "label"), [*keys, "label"], "left").withColumn("root", F.coalesce("root", "label"))
    own = written(own, "tile-labels")
    whole = own.groupBy(*keys, "root").agg(F.sum("area").alias("area"), F.max("strong").alias("strong"))
    named = own.select(*keys, "label", "root").join(whole, [*keys, "root"])
    tile = [F.expr(f"cast(shiftright(label, {PLACE}) div {size} as int)").alias("ty"), F.expr(f"cast((label & {(1 << PLACE) - 1}) div {size} as int)").alias("tx")]
    return named.groupBy("frame_id", *tile).agg(F.collect_list(F.struct("plane", "label", "root", "area", "strong")).alias("merged"))


def settle(planes: dict[str, Rule], size: int):
    """The planes by their rules, with the labels that reach beyond the tile as ``merged`` has them."""

    def run(batches):
        for raw in batches:
            b = Batch(raw, size)
            wide, lists = raw.column("frame_width").to_numpy().astype(np.int64), raw.column("merged")
            own = lists.flatten()
            tile = np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            field = lambda c: own.field(c).to_numpy(zero_copy_only=False)
            which, code, root = field("plane"), field("label"), field("root")
            place = lambda y, x, t: 1 + y * wide[t] + x
            at = b.starts[tile] + ((code >> PLACE) - b.top[tile]) * b.w[tile] + (code & ((1 << PLACE) - 1)) - b.left[tile]
            roots_ = place(root >> PLACE, root & ((1 << PLACE) - 1), tile)
            made = {}
            for k, (c, rule) in enumerate(planes.items()):
                plane = b.plane(c)
                on, label, area, strong = rule.local(plane, b.w, b.h)
                first = place(*b.at(np.arange(len(plane))), b.tile)
                mine = which == k
                first[at[mine]], area[at[mine]], strong[at[mine]] = roots_[mine], field("area")[mine], field("strong")[mine]
                made[c] = rule.out(plane, on, first[label], area[label], strong[label])
            out = b.with_planes(made)
            yield out.drop_columns(["frame_width", "merged"])

    return run


def connect(px: DataFrame, planes: dict[str, Rule], size: int = TILE) -> DataFrame:
    """``px`` with each of the planes replaced by what its rule makes of it; the other columns pass through.

    The tiles are written to the shared folder first: connectivity reads them more than once, and what
    comes before need not be planned or done again.
    """
    ship(px.sparkSession)
    tiles = written(pack(px, size), "tiles")
    if tiles.where("ty > 0 or tx > 0").isEmpty():

        def whole(batches):
            for raw in batches:
                b = Batch(raw, size)
                yield b.with_planes({c: rule(b.plane(c), b.w, b.h) for c, rule in planes.items()})

        return unpack(tiles.mapInArrow(whole, tiles.schema), size)
    borders = written(tiles.select("frame_id", "ty", "tx", "width", "height", *planes).mapInArrow(border_pixels(planes, size), BORDERS), "tile-borders")
    merged = merged_labels(borders, size)
    wide = tiles.groupBy("frame_id").agg(F.max(F.col("tx") * size + F.col("width")).alias("frame_width"))
    none = F.expr(f"cast(array() as {MERGED})")
    ready = tiles.join(wide, "frame_id").join(merged, ["frame_id", "ty", "tx"], "left").withColumn("merged", F.coalesce("merged", none))
    return unpack(ready.select(*tiles.columns, "frame_width", "merged").mapInArrow(settle(planes, size), tiles.schema), size)
