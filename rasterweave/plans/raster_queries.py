"""Raster queries over the rasters of ``embeddings``, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterweave.operators import clahe as clahe_op
from rasterweave.operators import connect, lineart, point, stencil, tiling
from rasterweave.plans import model
from rasterweave.functions import text
from rasterweave.sources import avi, blobs, images, loading
from rasterweave.sources.session import scratch, written
from rasterweave.sources.rasters import G8, M64, RGB8, gray8, mosaic64, pixels, rgb8, table
from rasterweave.streaming import failures

QUERIES, ORACLES = {}, {}
W3, W5 = stencil.gaussian_weights(1, 1.0), stencil.gaussian_weights(2, 1.1)
LOW, HIGH = 150, 400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def near(src: str, r: int, columns: str, name: str, last: int) -> str:
    """CTE of each pixel's (2r + 1)^2 neighbours with edges repeated."""
    own = ", ".join(f"q.{c} AS n{c}" for c in columns.split())
    return f"""{name}t AS MATERIALIZED (SELECT a.*, dy, dx, greatest(0, least({last}, a.y + dy)) AS qy, greatest(0, least({last}, a.x + dx)) AS qx
 FROM {src} a CROSS JOIN (SELECT unnest(range(-{r}, {r + 1})) AS dy) CROSS JOIN (SELECT unnest(range(-{r}, {r + 1})) AS dx)),
{name} AS (SELECT t.*, {own} FROM {name}t t JOIN {src} q ON q.frame_id = t.frame_id AND q.y = t.qy AND q.x = t.qx)"""


def weighted(src: str, weights: list[int], name: str, last: int, c: str = "v") -> str:
    """CTEs of a separable filter as one two-dimensional sum."""
    r, total, w = len(weights) // 2, sum(weights) ** 2, f"{weights}"
    return near(src, r, c, name + "n", last) + f""",
{name} AS (SELECT frame_id, y, x, CAST((2 * sum(CAST(n{c} AS HUGEINT) * ({w})[dy + {r + 1}] * ({w})[dx + {r + 1}]) + {total}) // {2 * total} AS INT) AS {c} FROM {name}n GROUP BY frame_id, y, x)"""


def bilateral_sql(src: str, diameter: int, sigma: float, name: str, last: int) -> str:
    r = diameter // 2
    place, differ = stencil.bilateral_tables(diameter, sigma)
    return near(src, r, "v", name + "n", last) + f""",
{name}w AS (SELECT frame_id, y, x, nv, CAST(({place})[(dy + {r}) * {2 * r + 1} + dx + {r + 1}] AS BIGINT) * ({differ})[abs(nv - v) + 1] // {stencil.ONE} AS w FROM {name}n),
{name} AS (SELECT frame_id, y, x, CAST((2 * sum(nv * w) + sum(w)) // (2 * sum(w)) AS INT) AS v FROM {name}w GROUP BY frame_id, y, x)"""


def sobel_sql(src: str, name: str, last: int, c: str = "v") -> str:
    return near(src, 1, c, name + "n", last) + f""",
{name} AS (SELECT frame_id, y, x, CAST(sum(n{c} * dx * (2 - abs(dy))) AS INT) AS gx, CAST(sum(n{c} * dy * (2 - abs(dx))) AS INT) AS gy FROM {name}n GROUP BY frame_id, y, x)"""


DIR = "CASE WHEN abs(gy) * 10000 <= abs(gx) * 4142 THEN 0 WHEN abs(gx) * 10000 <= abs(gy) * 4142 THEN 2 WHEN (gx > 0) = (gy > 0) THEN 1 ELSE 3 END"


def nms_sql(src: str, mag: str, name: str, last: int) -> str:
    """src has gx, gy."""
    return f"""{name}m AS (SELECT frame_id, y, x, CAST({mag} AS INT) AS mag, {DIR} AS dir FROM {src}),
{near(name + "m", 1, "mag", name + "n", last)},
{name} AS (SELECT frame_id, y, x, mag, dir, CASE WHEN bool_and(mag >= nmag) FILTER (WHERE (dir = 0 AND dy = 0 AND dx <> 0) OR (dir = 2 AND dx = 0 AND dy <> 0)
   OR (dir = 1 AND dx = dy AND dx <> 0) OR (dir = 3 AND dx = -dy AND dx <> 0)) THEN mag ELSE 0 END AS nms FROM {name}n GROUP BY frame_id, y, x, mag, dir)"""


def extreme_sql(src: str, f: str, inside: str, r: int, name: str, last: int, c: str = "m") -> str:
    return near(src, r, c, name + "n", last) + f""",
{name} AS MATERIALIZED (SELECT frame_id, y, x, {f}(n{c}) AS {c} FROM {name}n WHERE {inside} GROUP BY frame_id, y, x)"""


def closure_sql(states: str, name: str) -> str:
    """states: frame_id, y, x, state. Strong pixels and the weak ones they reach."""
    return f"""{name} AS (SELECT frame_id, y, x FROM {states} WHERE state = 2 UNION
 SELECT s.frame_id, s.y, s.x FROM {name} r JOIN {states} s ON s.frame_id = r.frame_id AND s.state >= 1 AND s.y BETWEEN r.y - 1 AND r.y + 1 AND s.x BETWEEN r.x - 1 AND r.x + 1)"""


LUMA = "CAST((299 * r + 587 * g + 114 * b + 500) // 1000 AS INT)"
MASK8 = "mk AS MATERIALIZED (SELECT frame_id, y, x, CASE WHEN v >= 150 THEN 255 ELSE 0 END AS m FROM g8)"
MASK64 = "mk AS MATERIALIZED (SELECT frame_id, y, x, CASE WHEN v >= 150 THEN 255 ELSE 0 END AS m FROM m64)"
FLAT = "SELECT frame_id, y, x, {} FROM {}"
ALL = "TRUE"


def mask(px, level=150):
    return px.select("frame_id", "y", "x", F.when(F.col("v") >= level, 255).otherwise(0).alias("m"))


def g8(spark, sf_dir):
    return stencil.by_frame(gray8(spark, sf_dir), pixels(spark, sf_dir))


def c8(spark, sf_dir):
    return stencil.by_frame(rgb8(spark, sf_dir), pixels(spark, sf_dir, 3))


def m64(spark, sf_dir):
    return stencil.by_frame(mosaic64(spark, sf_dir), pixels(spark, sf_dir))


def pick(px, *columns):
    return px.select("frame_id", "y", "x", *columns)


@query(f"WITH {RGB8} SELECT frame_id, y, x, r, g, b, CAST(4278190080 + b * 65536 + g * 256 + r AS BIGINT) AS packed, r AS ur, g AS ug, b AS ub, 255 AS ua FROM rgb8")
def drop_alpha_pack(spark, sf_dir):
    px = rgb8(spark, sf_dir).withColumn("packed", point.pack())
    return pick(px, "r", "g", "b", "packed", *[c.alias(n) for c, n in zip(point.unpack("packed"), ("ur", "ug", "ub", "ua"))])


@query(f"WITH {RGB8} SELECT frame_id, y, x, {LUMA} AS v FROM rgb8")
def luma_gray(spark, sf_dir):
    return pick(rgb8(spark, sf_dir), point.luma().alias("v"))


STATS = "st AS (SELECT frame_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * v) AS BIGINT) AS squares, min(v) AS lo, max(v) AS hi FROM {} GROUP BY frame_id)"


@query(f"WITH {G8}, {STATS.format('g8')} SELECT *, round(total / n, 6) AS mean, round(sqrt(CAST(n * squares - total * total AS DOUBLE)) / n, 6) AS std FROM st")
def frame_stats(spark, sf_dir):
    s = point.frame_stats(gray8(spark, sf_dir))
    return s.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(f"""WITH {G8}, dark AS (SELECT frame_id, y, x, v // 4 AS v FROM g8), {STATS.format('dark')}
SELECT frame_id, y, x, CAST(CASE WHEN total / n < 80 THEN floor(pow(v / 255.0::DOUBLE, 1 / greatest(1.5, least(3.0, 1.0 + (80 - total / n) / 40))) * 255 + 0.5) ELSE v END AS INT) AS v FROM dark JOIN st USING (frame_id)""")
def gamma_lift(spark, sf_dir):
    px = gray8(spark, sf_dir).withColumn("v", F.expr("cast(v div 4 as int)"))
    px = px.withColumn("mean", F.avg("v").over(point.frame()))
    return pick(point.gamma_lift(px), "v")


@query(f"""WITH {G8}, flat AS (SELECT frame_id, y, x, 60 + v // 3 AS v FROM g8), {STATS.format('flat')}
SELECT frame_id, y, x, CAST(CASE WHEN hi > lo AND sqrt(CAST(n * squares - total * total AS DOUBLE)) / n < 45 THEN (2 * (v - lo) * 255 + (hi - lo)) // (2 * (hi - lo)) ELSE v END AS INT) AS v FROM flat JOIN st USING (frame_id)""")
def minmax_stretch(spark, sf_dir):
    px = gray8(spark, sf_dir).withColumn("v", F.expr("cast(60 + v div 3 as int)"))
    n, t = F.count("v").over(point.frame()), F.sum("v").over(point.frame())
    px = px.withColumn("std", F.sqrt((n * F.sum(F.col("v") * F.col("v")).over(point.frame()) - t * t).cast("double")) / n)
    return pick(point.stretch(px), "v")


@query(f"WITH {G8}, {MASK8} SELECT frame_id, y, x, 255 - m AS m FROM mk")
def invert_mask(spark, sf_dir):
    return pick(mask(gray8(spark, sf_dir)), (255 - F.col("m")).alias("m"))


SOBEL = f"{G8}, {sobel_sql('g8', 'sb', 7)}"


@query(f"WITH {SOBEL} SELECT frame_id, y, x, gx, gy, abs(gx) + abs(gy) AS mag FROM sb")
def sobel_l1(spark, sf_dir):
    return pick(stencil.sobel(g8(spark, sf_dir)), "gx", "gy", stencil.magnitude().alias("mag"))


@query(f"WITH {SOBEL} SELECT frame_id, y, x, {DIR} AS dir FROM sb")
def sobel_direction(spark, sf_dir):
    return pick(stencil.sobel(g8(spark, sf_dir)), stencil.direction().alias("dir"))


STATE = "CASE WHEN {0} >= %d THEN 2 WHEN {0} >= %d THEN 1 ELSE 0 END" % (HIGH, LOW)


@query(f"WITH {SOBEL} SELECT frame_id, y, x, {STATE.format('abs(gx) + abs(gy)')} AS state FROM sb")
def double_threshold(spark, sf_dir):
    return pick(stencil.sobel(g8(spark, sf_dir)), stencil.threshold(stencil.magnitude(), LOW, HIGH).alias("state"))


@query(f"WITH {SOBEL} SELECT frame_id, y, x, CASE WHEN abs(gx) + abs(gy) >= {HIGH} THEN 255 ELSE 0 END AS m FROM sb")
def finalize_mask(spark, sf_dir):
    px = double_threshold(spark, sf_dir)
    return pick(px, F.when(F.col("state") == 2, 255).otherwise(0).alias("m"))


@query(f"WITH {G8}, {weighted('g8', W3, 'ga', 7)} SELECT * FROM ga")
def gaussian3(spark, sf_dir):
    return pick(stencil.gaussian(g8(spark, sf_dir), 1, 1.0), "v")


@query(f"WITH {G8}, {weighted('g8', W5, 'ga', 7)} SELECT * FROM ga")
def gaussian5(spark, sf_dir):
    return pick(stencil.gaussian(g8(spark, sf_dir), 2, 1.1), "v")


@query(f"WITH {G8}, {near('g8', 1, 'v', 'nb', 7)} SELECT frame_id, y, x, (list_sort(list(nv)))[5] AS v FROM nb GROUP BY frame_id, y, x")
def median3(spark, sf_dir):
    return pick(stencil.median(g8(spark, sf_dir)), "v")


@query(f"WITH {G8}, {bilateral_sql('g8', 5, 45, 'bi', 7)} SELECT * FROM bi")
def bilateral(spark, sf_dir):
    return pick(stencil.bilateral(g8(spark, sf_dir), 5, 45), "v")


@query(f"WITH {G8}, {bilateral_sql('g8', 5, 45, 'b1', 7)}, {bilateral_sql('b1', 5, 23, 'b2', 7)} SELECT * FROM b2")
def bilateral_multipass(spark, sf_dir):
    return pick(stencil.smooth(g8(spark, sf_dir), 5, 45, 23, 2), "v")


def bilateral_rgb_sql(src, diameter, sigma, name, last=7):
    r = diameter // 2
    place, differ = stencil.bilateral_tables(diameter, sigma, 3)
    planes = ", ".join(f"CAST((2 * sum(n{c} * w) + sum(w)) // (2 * sum(w)) AS INT) AS {c}" for c in "rgb")
    return near(src, r, "r g b", name + "n", last) + f""",
{name}w AS (SELECT frame_id, y, x, nr, ng, nb, CAST(({place})[(dy + {r}) * {2 * r + 1} + dx + {r + 1}] AS BIGINT) * ({differ})[abs(nr - r) + abs(ng - g) + abs(nb - b) + 1] // {stencil.ONE} AS w FROM {name}n),
{name} AS MATERIALIZED (SELECT frame_id, y, x, {planes} FROM {name}w GROUP BY frame_id, y, x)"""


@query(f"WITH {RGB8}, {bilateral_rgb_sql('rgb8', 5, 45, 'bl')} SELECT * FROM bl")
def bilateral_rgb(spark, sf_dir):
    return pick(stencil.bilateral_rgb(c8(spark, sf_dir), 5, 45), "r", "g", "b")


NMS = f"{SOBEL}, {nms_sql('sb', 'abs(gx) + abs(gy)', 'nm', 7)}"


def _thin(px, norm="l1"):
    px = stencil.sobel(px).withColumn("mag", stencil.magnitude(norm)).withColumn("dir", stencil.direction())
    return stencil.suppress(px)


@query(f"WITH {NMS} SELECT frame_id, y, x, nms FROM nm")
def nms(spark, sf_dir):
    return pick(_thin(g8(spark, sf_dir)), "nms")


@query(f"WITH {NMS}, s AS (SELECT frame_id, y, x, {STATE.format('nms')} AS state FROM nm), {near('s', 1, 'state', 'sn', 7)} "
       "SELECT frame_id, y, x, CASE WHEN state >= 1 AND max(nstate) = 2 THEN 2 ELSE 0 END AS state FROM sn GROUP BY frame_id, y, x, state")
def hysteresis_onehop(spark, sf_dir):
    px = _thin(g8(spark, sf_dir)).withColumn("state", stencil.threshold(F.col("nms"), LOW, HIGH))
    return pick(stencil.hysteresis_once(px), "state")


def closure(px, size=connect.TILE):
    return connect.connect(px.select("frame_id", "y", "x", F.col("state").alias("m")), {"m": connect.closure}, size)


@query(f"WITH RECURSIVE {SOBEL}, s AS (SELECT frame_id, y, x, {STATE.format('abs(gx) + abs(gy)')} AS state FROM sb), {closure_sql('s', 'hy')} "
       "SELECT s.frame_id, s.y, s.x, CASE WHEN hy.y IS NULL THEN 0 ELSE 255 END AS m FROM s LEFT JOIN hy ON hy.frame_id = s.frame_id AND hy.y = s.y AND hy.x = s.x")
def hysteresis_closure(spark, sf_dir):
    return closure(double_threshold(spark, sf_dir))


def canny_sql(src, low, high, name, last):
    return f"""{sobel_sql(src, name + 's', last)}, {nms_sql(name + 's', 'gx * gx + gy * gy', name + 't', last)},
{name}q AS (SELECT frame_id, y, x, CASE WHEN nms >= {high * high} THEN 2 WHEN nms >= {low * low} THEN 1 ELSE 0 END AS state FROM {name}t), {closure_sql(name + 'q', name + 'r')},
{name} AS (SELECT q.frame_id, q.y, q.x, CASE WHEN r.y IS NULL THEN 0 ELSE 255 END AS m FROM {name}q q LEFT JOIN {name}r r ON r.frame_id = q.frame_id AND r.y = q.y AND r.x = q.x)"""


@query(f"WITH RECURSIVE {G8}, {canny_sql('g8', 150, 300, 'ca', 7)} SELECT * FROM ca")
def canny(spark, sf_dir):
    return closure(lineart.states(g8(spark, sf_dir), "v", 150, 300, "state"))


@query(f"WITH {M64}, {MASK64}, {extreme_sql('mk', 'max', 'dy * dy + dx * dx <= 9', 3, 'ex', 63)} SELECT * FROM ex")
def dilate_disc(spark, sf_dir):
    return pick(stencil.disc(mask(m64(spark, sf_dir)), "m", 3, True), "m")


@query(f"WITH {M64}, {MASK64}, {extreme_sql('mk', 'min', 'dy * dy + dx * dx <= 4', 2, 'ex', 63)} SELECT * FROM ex")
def erode_disc(spark, sf_dir):
    return pick(stencil.disc(mask(m64(spark, sf_dir)), "m", 2, False), "m")


@query(f"WITH {M64}, {MASK64}, {extreme_sql('mk', 'max', ALL, 1, 'e1', 63)}, {extreme_sql('e1', 'min', ALL, 1, 'e2', 63)} SELECT * FROM e2")
def close3(spark, sf_dir):
    return pick(stencil.close(mask(m64(spark, sf_dir))), "m")


@query(f"WITH {M64}, {MASK64}, {extreme_sql('mk', 'min', 'dy * dy + dx * dx <= 1', 1, 'e1', 63)}, {extreme_sql('e1', 'max', 'dy * dy + dx * dx <= 1', 1, 'e2', 63)} SELECT * FROM e2")
def open_r(spark, sf_dir):
    return pick(stencil.open_disc(mask(m64(spark, sf_dir))), "m")


@query(f"WITH {M64}, {MASK64}, {extreme_sql('mk', 'max', ALL, 2, 'e1', 63)}, {extreme_sql('e1', 'min', ALL, 2, 'e2', 63)}, {extreme_sql('e2', 'min', ALL, 1, 'e3', 63)} SELECT * FROM e3")
def merge_double_edge(spark, sf_dir):
    return pick(stencil.merge_double_edge(mask(m64(spark, sf_dir)), 1), "m")


@query(f"WITH {M64}, {MASK64}, {extreme_sql('mk', 'max', 'dy * dy + dx * dx <= 1', 1, 'ex', 63)} SELECT * FROM ex")
def line_weight(spark, sf_dir):
    return pick(stencil.line_weight(mask(m64(spark, sf_dir)), 2), "m")


@query(f"WITH {RGB8}, {near('rgb8', 1, 'r g b', 'bm', 7)} SELECT frame_id, y, x, CAST((2 * sum(nr) + 9) // 18 AS INT) AS r, CAST((2 * sum(ng) + 9) // 18 AS INT) AS g, CAST((2 * sum(nb) + 9) // 18 AS INT) AS b FROM bm GROUP BY frame_id, y, x")
def box_mean(spark, sf_dir):
    return pick(stencil.box_mean(c8(spark, sf_dir), 1), "r", "g", "b")


def clahe_sql(src, clip, name, t):
    """Frames of 8 x 8 tiles of t x t pixels; ``clip`` may name a column of ``src`` that is one value a frame."""
    share = lambda c, d: f"(CASE {d} WHEN 1 THEN 2 * {c} + 1 - {t} - {2 * t} * c{c} ELSE {2 * t} - (2 * {c} + 1 - {t} - {2 * t} * c{c}) END)"
    whole = 4 * t * t
    return f"""{name}h AS (SELECT frame_id, y // {t} AS ty, x // {t} AS tx, v, count(*) AS n, any_value({clip}) AS clip FROM {src} GROUP BY frame_id, y // {t}, x // {t}, v),
{name}h2 AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS area, greatest(1, CAST(floor(sum(n) OVER w * clip / 256) AS BIGINT)) AS most FROM {name}h WINDOW w AS (PARTITION BY frame_id, ty, tx)),
{name}c AS (SELECT frame_id, ty, tx, max(area) AS area, CAST(sum(greatest(0, n - most)) AS BIGINT) AS cut FROM {name}h2 GROUP BY ALL),
{name}f AS (SELECT c.*, l.level, coalesce(least(n, most), 0) AS kept FROM {name}c c CROSS JOIN (SELECT unnest(range(256)) AS level) l LEFT JOIN {name}h2 h ON h.frame_id = c.frame_id AND h.ty = c.ty AND h.tx = c.tx AND h.v = l.level),
{name}r AS (SELECT *, CAST(sum(kept) OVER (PARTITION BY frame_id, ty, tx ORDER BY level) AS BIGINT) + (level + 1) * (cut // 256) + least(level + 1, cut % 256) AS run FROM {name}f),
{name}m AS (SELECT frame_id, ty, tx, level, (2 * run * 255 + area) // (2 * area) AS lut FROM {name}r),
{name}p AS (SELECT *, CAST(floor((2 * y + 1 - {t}) / {2 * t}) AS INT) AS cy, CAST(floor((2 * x + 1 - {t}) / {2 * t}) AS INT) AS cx FROM {src}),
{name}a AS (SELECT p.*, dy, dx, {share('y', 'dy')} * {share('x', 'dx')} AS w
 FROM {name}p p CROSS JOIN (SELECT unnest([0, 1]) AS dy) CROSS JOIN (SELECT unnest([0, 1]) AS dx)),
{name} AS MATERIALIZED (SELECT a.frame_id, a.y, a.x, CAST((2 * sum(w * lut) + {whole}) // {2 * whole} AS INT) AS v FROM {name}a a JOIN {name}m m ON m.frame_id = a.frame_id AND m.level = a.v
 AND m.ty = greatest(0, least(7, cy + dy)) AND m.tx = greatest(0, least(7, cx + dx)) GROUP BY a.frame_id, a.y, a.x)"""


@query(f"WITH {M64}, {clahe_sql('m64', '8.0::DOUBLE', 'cl', 8)} SELECT * FROM cl")
def clahe(spark, sf_dir):
    return pick(clahe_op.clahe(m64(spark, sf_dir), 8.0), "v")


def labels_sql(src, wide, name):
    return f"""{name}f AS (SELECT frame_id, y, x, y * {wide} + x + 1 AS p FROM {src} WHERE m > 0),
{name}r AS (SELECT frame_id, p, p AS q, y, x FROM {name}f UNION SELECT r.frame_id, r.p, f.p, f.y, f.x FROM {name}r r JOIN {name}f f ON f.frame_id = r.frame_id AND f.y BETWEEN r.y - 1 AND r.y + 1 AND f.x BETWEEN r.x - 1 AND r.x + 1),
{name}lab AS (SELECT frame_id, p, min(q) AS label FROM {name}r GROUP BY frame_id, p),
{name}areas AS (SELECT frame_id, CAST(label AS BIGINT) AS label, count(*) AS area FROM {name}lab GROUP BY ALL)"""


def clean_sql(src, wide, least, name):
    return labels_sql(src, wide, name) + f""",
{name} AS MATERIALIZED (SELECT s.frame_id, s.y, s.x, CASE WHEN area >= {least} THEN 255 ELSE 0 END AS m FROM {src} s LEFT JOIN {name}lab l ON l.frame_id = s.frame_id AND l.p = s.y * {wide} + s.x + 1 LEFT JOIN {name}areas a ON a.frame_id = l.frame_id AND a.label = l.label)"""


AREAS = f"WITH RECURSIVE {M64}, {MASK64}, {labels_sql('mk', 64, 'co')} SELECT frame_id, label, area FROM coareas"
CLEAN = f"WITH RECURSIVE {M64}, {MASK64}, {clean_sql('mk', 64, model.MIN_AREA[1], 'cs')} SELECT * FROM cs"


def _labelled(spark, sf_dir, size=connect.TILE):
    px = mask(mosaic64(spark, sf_dir)).withColumn("m", F.col("m").cast("long"))
    return connect.connect(px, {"m": connect.component}, size).withColumnRenamed("m", "label")


@query(AREAS)
def components_area(spark, sf_dir):
    return _labelled(spark, sf_dir).where("label > 0").groupBy("frame_id", "label").agg(F.count("*").alias("area"))


@query(AREAS)
def tiled_components(spark, sf_dir):
    """Labels joined across tiles of 24 x 24, whose last ones are cut."""
    return _labelled(spark, sf_dir, 24).where("label > 0").groupBy("frame_id", "label").agg(F.count("*").alias("area"))


@query(CLEAN)
def clean_speckles(spark, sf_dir):
    """Area filter as aggregation and join on (frame_id, label)."""
    lab = _labelled(spark, sf_dir)
    large = lab.where("label > 0").groupBy("frame_id", "label").count().where(f"count >= {model.MIN_AREA[1]}").select("frame_id", "label", F.lit(255).alias("kept"))
    return lab.join(large, ["frame_id", "label"], "left").select("frame_id", "y", "x", F.coalesce("kept", F.lit(0)).alias("m"))


@query(CLEAN)
def tiled_clean_speckles(spark, sf_dir):
    """Area filter on tiles of 16 x 16: areas of components that cross their borders are added up."""
    return connect.connect(mask(mosaic64(spark, sf_dir)), {"m": connect.without_specks(model.MIN_AREA[1])}, 16)


@query(f"WITH RECURSIVE {M64}, {sobel_sql('m64', 'sb', 63)}, s AS (SELECT frame_id, y, x, {STATE.format('abs(gx) + abs(gy)')} AS state FROM sb), {closure_sql('s', 'hy')} "
       "SELECT s.frame_id, s.y, s.x, CASE WHEN hy.y IS NULL THEN 0 ELSE 255 END AS m FROM s LEFT JOIN hy ON hy.frame_id = s.frame_id AND hy.y = s.y AND hy.x = s.x")
def tiled_hysteresis(spark, sf_dir):
    """Weak pixels reach strong ones across tiles of 16 x 16."""
    px = stencil.sobel(m64(spark, sf_dir)).withColumn("state", stencil.threshold(stencil.magnitude(), LOW, HIGH))
    return closure(px, 16)


INK = f"{RGB8}, gr AS (SELECT *, {LUMA} AS v FROM rgb8), {sobel_sql('gr', 'sb', 7)}, ed AS (SELECT gr.*, abs(gx) + abs(gy) AS mag FROM gr JOIN sb USING (frame_id, y, x))"


def _inked(spark, sf_dir):
    px = stencil.sobel(c8(spark, sf_dir).withColumn("v", point.luma()))
    return px.withColumn("mag", stencil.magnitude())


@query(f"WITH {INK} SELECT frame_id, y, x, CASE WHEN mag >= 300 THEN 23 ELSE 248 END AS r, CASE WHEN mag >= 300 THEN 33 ELSE 245 END AS g, CASE WHEN mag >= 300 THEN 47 ELSE 237 END AS b FROM ed")
def colorize(spark, sf_dir):
    p = model.preset("studio")
    return point.colorize(_inked(spark, sf_dir), p.background, p.ink, F.col("mag") >= 300)


@query(f"WITH {INK} SELECT frame_id, y, x, CASE WHEN mag >= 300 THEN 0 WHEN mag >= 120 THEN r ELSE 255 END AS r, CASE WHEN mag >= 300 THEN 0 WHEN mag >= 120 THEN g ELSE 255 END AS g, CASE WHEN mag >= 300 THEN 0 WHEN mag >= 120 THEN b ELSE 255 END AS b FROM ed")
def colorize_color_edges(spark, sf_dir):
    p = model.preset("manga")
    return point.colorize(_inked(spark, sf_dir), p.background, p.ink, F.col("mag") >= 300, F.col("mag") >= 120)


def _mix(c, k):
    bg, ink = model.preset("warm").background[k], model.preset("warm").ink[k]
    return f"CAST(CASE WHEN mag >= 300 THEN {ink} WHEN mag >= 120 THEN floor({bg} * (1 - 0.5::DOUBLE) + {c} * 0.5::DOUBLE) ELSE {bg} END AS INT) AS {c}"


@query(f"WITH {INK} SELECT frame_id, y, x, {_mix('r', 0)}, {_mix('g', 1)}, {_mix('b', 2)} FROM ed")
def opacity_blend(spark, sf_dir):
    p = model.preset("warm")
    return point.colorize(_inked(spark, sf_dir), p.background, p.ink, F.col("mag") >= 300, F.col("mag") >= 120, 0.5)


@query(f"WITH {M64} SELECT frame_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST((2 * sum(v) + count(*)) // (2 * count(*)) AS INT) AS v FROM m64 GROUP BY frame_id, y // 2, x // 2")
def resample_half(spark, sf_dir):
    return point.resample(mosaic64(spark, sf_dir), 0.5)


#: 64 pixels to 48: in units of 1 / (64 * 48) a source pixel is 48 wide, a target 64.
@query(f"""WITH {M64}, o AS (SELECT s, t, least((s + 1) * 48, (t + 1) * 64) - greatest(s * 48, t * 64) AS part FROM (SELECT unnest(range(64)) AS s) CROSS JOIN (SELECT unnest(range(48)) AS t))
SELECT frame_id, CAST(a.t AS INT) AS y, CAST(b.t AS INT) AS x, CAST((2 * sum(v * a.part * b.part) + 4096) // 8192 AS INT) AS v FROM m64 JOIN o a ON a.s = y AND a.part > 0 JOIN o b ON b.s = x AND b.part > 0 GROUP BY frame_id, a.t, b.t""")
def resample_default(spark, sf_dir):
    """The default scale, where targets lie across source pixels."""
    return point.resample(mosaic64(spark, sf_dir), 0.75)


def gamma_sql(c):
    return f"CAST(CASE WHEN mean < 80 THEN floor(pow({c} / 255.0::DOUBLE, 1 / greatest(1.5, least(3.0, 1.0 + (80 - mean) / 40))) * 255 + 0.5) ELSE {c} END AS INT)"


def stretch_sql(src, name, when="TRUE"):
    return f"""{name}w AS (SELECT *, min(v) OVER (PARTITION BY frame_id) AS lo, max(v) OVER (PARTITION BY frame_id) AS hi FROM {src}),
{name} AS MATERIALIZED (SELECT * EXCLUDE (lo, hi) REPLACE (CAST(CASE WHEN hi > lo AND {when} THEN (2 * (v - lo) * 255 + (hi - lo)) // (2 * (hi - lo)) ELSE v END AS INT) AS v) FROM {name}w)"""


def lineart_sql(s):
    """DuckDB SQL of a render of the 8 x 8 colour rasters, one CTE or a few a stage."""
    d, p, ctes, last = s.derived(), s.preset, [RGB8, f"raw AS MATERIALIZED (SELECT *, {LUMA} AS v FROM rgb8)"], 7
    normal, colour = s.auto_normalize or not s.custom, s.custom and s.color_edges

    def stage(sql, name):
        ctes.append(sql)
        return name

    at = "rgb8"
    for k, sigma in enumerate(lineart.smoothing(s)):
        at = stage(bilateral_rgb_sql(at, p.diameter, sigma, f"sm{k}"), f"sm{k}")
    at = stage(f"gr AS (SELECT frame_id, y, x, {LUMA} AS v FROM {at})", "gr")
    for k in range(s.gaussian_passes if s.custom and s.gaussian else 0):
        at = stage(weighted(at, W5, f"gp{k}", last), f"gp{k}")
    for k in range(s.median_passes if s.custom and s.median else 0):
        at = stage(f"{near(at, 1, 'v', f'mp{k}n', last)}, mp{k} AS (SELECT frame_id, y, x, (list_sort(list(nv)))[5] AS v FROM mp{k}n GROUP BY frame_id, y, x)", f"mp{k}")
    ctes.append(f"{STATS.format('raw')}, ms AS (SELECT frame_id, total / n AS mean, sqrt(CAST(n * squares - total * total AS DOUBLE)) / n AS std FROM st)")
    source = "raw"
    if normal:
        ctes.append(f"lift AS MATERIALIZED (SELECT frame_id, y, x, {gamma_sql('v')} AS v, std, greatest(1.5, least(4.5, 150 / greatest(mean, 1.0))) AS clip FROM {at} JOIN ms USING (frame_id))")
        source = stage(f"rl AS (SELECT frame_id, y, x, {gamma_sql('v')} AS v FROM raw JOIN ms USING (frame_id))", "rl")
        ctes.append(stretch_sql("lift", "str", "std < 45"))
        at = stage(clahe_sql("str", "clip", "ac", 1), "ac")
    at = stage(weighted(at, W5, "pre", last), "pre")
    if s.custom and s.dark_boost:
        at = stage(clahe_sql(at, f"{float(s.dark_boost_clip)}::DOUBLE", "mc", 1), "mc")
    ctes.append(canny_sql(at, d["low"], d["high"], "ca", last))
    at = stage(f"{extreme_sql('ca', 'max', ALL, 1, 'k1', last)}, {extreme_sql('k1', 'min', ALL, 1, 'k2', last)}", "k2")
    if s.custom and s.clean_speckles:
        at = stage(clean_sql(at, 8, model.MIN_AREA[s.clean_intensity], "cs"), "cs")
    if s.custom and s.merge_double_edge:
        r = 1 + s.merge_intensity
        at = stage(f"{extreme_sql(at, 'max', ALL, r, 'd1', last)}, {extreme_sql('d1', 'min', ALL, r, 'd2', last)}, {extreme_sql('d2', 'min', ALL, 1, 'd3', last)}", "d3")
    disc = lambda w: f"dy * dy + dx * dx <= {(w - 1) ** 2}"
    if s.line_weight > 1:
        at = stage(extreme_sql(at, "max", disc(s.line_weight), s.line_weight - 1, "lw", last), "lw")
    planes = [f"CAST(CASE WHEN e.m > 127 THEN {i} ELSE {b} END AS INT) AS {c}" for i, b, c in zip(p.ink, p.background, "rgb")]
    joined = f"FROM {at} e"
    if colour:
        if s.color_softness:
            soft = stencil.gaussian_weights(*lineart.softness(s))
            ctes.append(f"{weighted(source, soft, 'cb', last)}, {stretch_sql('cb', 'cst')}, " + ", ".join(weighted("rgb8", soft, f"paint{c}", last, c) for c in "rgb"))
            source, paint = "cst", "".join(f" JOIN paint{c} USING (frame_id, y, x)" for c in "rgb")
        else:
            paint = " JOIN rgb8 USING (frame_id, y, x)"
        lines = stage(canny_sql(source, s.color_low, s.color_high, "cl", last), "cl")
        if s.color_line_weight > 1:
            lines = stage(extreme_sql(lines, "max", disc(s.color_line_weight), s.color_line_weight - 1, "clw", last), "clw")
        op = float(s.color_opacity)
        mixed = lambda c, b: f"floor({b} * (1 - {op}::DOUBLE) + {gamma_sql(c) if normal else c} * {op}::DOUBLE)"
        planes = [f"CAST(CASE WHEN e.m > 127 THEN {i} WHEN l.m > 127 THEN {mixed(c, b)} ELSE {b} END AS INT) AS {c}" for i, b, c in zip(p.ink, p.background, "rgb")]
        joined = f"FROM {at} e JOIN {lines} l USING (frame_id, y, x){paint} JOIN ms USING (frame_id)"
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT frame_id, y, x, {', '.join(planes)} {joined}"


def _rendered(spark, sf_dir, settings, tile=None):
    return lineart.line_art(rgb8(spark, sf_dir), settings, tile, pixels(spark, sf_dir, 3))


def _art(name, settings):
    def art(spark, sf_dir):
        return _rendered(spark, sf_dir, settings)

    art.__name__ = f"lineart_{name}"
    query(lineart_sql(settings))(art)


for _key in model.NAMES:
    _art(_key, model.Settings(preset=model.preset(_key)))
_art("custom", model.Settings(preset=model.preset("custom", diameter=5), custom=True, gaussian=True, median=True, clean_intensity=1, merge_intensity=1, dark_boost=True, color_edges=True, color_softness=2, color_line_weight=2, color_opacity=0.5))
_art("plain", model.Settings(preset=model.preset("custom", background=(250, 250, 240), ink=(20, 20, 60)), custom=True, bilateral=False, clean_speckles=False, auto_normalize=False, merge_double_edge=False, line_weight=1, color_edges=True, color_low=30, color_high=90))


@query(lineart_sql(model.Settings(preset=model.preset("blueprint"))))
def tiled_lineart(spark, sf_dir):
    """A render on tiles of 4 x 4 with halos: statistics and histograms first, lines joined across tiles."""
    return _rendered(spark, sf_dir, model.Settings(preset=model.preset("blueprint")), 4)


def flagship(spark, sf_dir):
    """Sobel edges of the gray rasters, one-hop hysteresis, coloured by a preset."""
    p = model.preset("manga")
    px = stencil.sobel(g8(spark, sf_dir)).withColumn("state", stencil.threshold(stencil.magnitude(), LOW, HIGH))
    px = stencil.hysteresis_once(px)
    return point.colorize(px, p.background, p.ink, F.col("state") == 2)


@query(f"WITH {M64}, {near('m64', 1, 'v', 'nb', 63)} SELECT frame_id, y, x, (list_sort(list(nv)))[5] AS v FROM nb GROUP BY frame_id, y, x")
def tiled_median(spark, sf_dir):
    """A stencil on 16 x 16 tiles with a halo equals the one on whole frames."""
    px = tiling.tiled(mosaic64(spark, sf_dir), 16, 1, 64, 64)
    return pick(tiling.untiled(stencil.median(stencil.by_frame(px, 2 * pixels(spark, sf_dir))), 16), "v")


@query(lineart_sql(model.Settings()))
def png_sink(spark, sf_dir):
    """Renders written as PNG files, one a frame, and read back with Spark's image source."""
    art = _rendered(spark, sf_dir, model.Settings())
    folder = scratch(spark, "png-files")
    images.write_png_files(images.frames_of(art), folder)
    read = images.read_images(spark, folder).where("readable")
    read = read.withColumn("frame_id", F.regexp_extract("path", r"frame-(\d+)\.png\z", 1).cast("long"))
    return images.image_pixels(read, "frame_id")


@query(lineart_sql(model.Settings(preset=model.preset("studio"))))
def png_source(spark, sf_dir):
    """Renders written by tasks that commit together, and read back by the file source and our own decoder."""
    art = _rendered(spark, sf_dir, model.Settings(preset=model.preset("studio")))
    folder = scratch(spark, "png-blobs")
    images.write_png_files(images.frames_of(art), folder)
    files = blobs.read_blobs(spark, folder).select(F.regexp_extract("file", r"frame-(\d+)\.png\z", 1).cast("long").alias("frame_id"), "content")
    return images.rgb_pixels(images.png_frames(files), "frame_id")


#: Frames to a chunk file and chunk files to a video, in the order of their frames.
PER_CHUNK, PER_VIDEO = 12, 5
PLACED = f"pl AS (SELECT frame_id, frame_id // {PER_CHUNK * PER_VIDEO} AS video, row_number() OVER (PARTITION BY frame_id // {PER_CHUNK * PER_VIDEO} ORDER BY frame_id) - 1 AS place FROM (SELECT DISTINCT frame_id FROM rgb8))"


@query(f"WITH {RGB8}, {PLACED} SELECT CAST(video AS BIGINT) AS video, place, y, x, r, g, b FROM rgb8 JOIN pl USING (frame_id)")
def avi_join(spark, sf_dir):
    """Frames encoded to chunk files, these joined to videos without decoding, and the videos' frames read back by seeking."""
    png = images.with_png(images.frames_of(rgb8(spark, sf_dir)))
    chunked = png.select(F.expr(f"frame_id div {PER_CHUNK * PER_VIDEO}").alias("video"), F.expr(f"frame_id div {PER_CHUNK}").alias("chunk"), F.col("frame_id").alias("within"), "width", "height", "png")
    files = written(avi.mux_chunks(chunked, ["video", "chunk"], 12.0), "chunk-files")
    folder = scratch(spark, "videos")
    avi.write_joined(avi.join_chunks(files, "video", ["chunk"]), "video", ["chunk"], folder).write.format("noop").mode("overwrite").save()
    frames = avi.read_frames(spark, folder).select(F.regexp_extract("file", r"\A(\d+)", 1).cast("long").alias("video"), "place", "content")
    return images.rgb_pixels(images.png_frames(frames), "video", "place")


#: By the first pixel's red: a frame's file is not written, empty, or cut in half.
MISSING, EMPTY, CUT = 60, 100, 140
FIRST = "fp AS (SELECT frame_id, r AS red FROM rgb8 WHERE y = 0 AND x = 0)"


def _files(spark, sf_dir):
    """(file, content, red): a PNG file a frame, damaged as above."""
    px = rgb8(spark, sf_dir)
    png = images.with_png(images.frames_of(px)).join(px.where("y = 0 and x = 0").select("frame_id", F.col("r").alias("red")), "frame_id")
    content = F.when(F.col("red") < EMPTY, F.unhex(F.lit(""))).when(F.col("red") < CUT, F.expr("substring(png, 1, cast(length(png) div 2 as int))")).otherwise(F.col("png"))
    return png.select("frame_id", F.format_string("frame-%05d.png", "frame_id").alias("file"), content.alias("content"), "red")


@query(f"WITH {RGB8}, {FIRST} SELECT 'frame-' || lpad(CAST(frame_id AS VARCHAR), 5, '0') || '.png' AS file, red >= {CUT} AS loaded, "
       f"CASE WHEN red < {MISSING} THEN 'missing' WHEN red < {EMPTY} THEN 'empty' WHEN red < {CUT} THEN 'damaged' END AS reason, red >= {CUT} AND red > 180 AS has_audio, CASE WHEN red >= {CUT} THEN red / 10.0::DOUBLE ELSE 30.0 END AS fps FROM fp")
def source_fallback(spark, sf_dir):
    """Sources that are missing, empty or damaged are rows like others: played without audio at the configured rate."""
    files = written(_files(spark, sf_dir), "source-files")
    folder = scratch(spark, "sources")
    blobs.write_blobs(files.where(f"red >= {MISSING}"), folder)
    wanted = files.select("file", (F.col("red") / 10.0).alias("fps"), (F.col("red") > 180).alias("has_audio"))
    return loading.load(wanted, blobs.read_blobs(spark, folder))


@query(f"WITH {RGB8}, {FIRST}, bad AS (SELECT frame_id FROM fp WHERE red < {CUT}) SELECT frame_id, red < {CUT} AS failed, red < {CUT} AND frame_id = (SELECT min(frame_id) FROM bad) AS raised, CASE WHEN red >= {CUT} THEN total END AS total "
       "FROM fp JOIN (SELECT frame_id, CAST(sum(r + g + b) AS BIGINT) AS total FROM rgb8 GROUP BY 1) USING (frame_id)")
def frame_failures(spark, sf_dir):
    """Every frame is attempted; those that fail are reported and the first of them is raised after the batch."""
    out = scratch(spark, "outcomes")
    step = lambda row: {"total": int(images.unpng(bytes(row["content"]))[2].sum())}
    raised = None
    try:
        failures.settle(failures.attempted(_files(spark, sf_dir), step, "total long"), out)
    except failures.FrameError as e:
        raised = e.index
    failed = F.col("error").isNotNull()
    return spark.read.parquet(out).select("frame_id", failed.alias("failed"), (failed & F.col("frame_id").eqNullSafe(F.lit(raised).cast("long"))).alias("raised"), "total")


PAGE_FILE = "lpad(CAST(page_id AS VARCHAR), 7, '0') || CASE WHEN ends_with(regexp_extract(url, '^[^?#]*'), '.html') THEN '.PNG' WHEN regexp_matches(regexp_extract(url, '^[^?#]*'), '[0-9]$') THEN '.mp4' ELSE '.txt' END"


@query(f"""WITH f AS (SELECT {PAGE_FILE} AS file, 8 + octet_length(encode(coalesce(html, ''))) AS length, CASE WHEN contains(url, '/en/') THEN 'image' WHEN contains(url, '/fr/') THEN 'video' END AS marked FROM pages),
n AS (SELECT *, CASE right(file, 4) WHEN '.PNG' THEN 'image/png' WHEN '.mp4' THEN 'video/mp4' END AS mime, CASE right(file, 4) WHEN '.PNG' THEN 'image' WHEN '.mp4' THEN 'video' END AS named FROM f)
SELECT file, CAST(length AS BIGINT) AS length, mime, named, marked, coalesce(marked, named) AS kind, file = (SELECT min(file) FROM f) AS first FROM n""")
def media_scan(spark, sf_dir):
    """A folder of files listed: their kind by name and by content, and the first."""
    mark = F.when(F.col("url").contains("/en/"), "89504E470D0A1A0A").when(F.col("url").contains("/fr/"), "0000002066747970").otherwise("3C212D2D2D2D3E0A")
    mime = text.mime_of(F.col("url"))
    extension = F.when(mime == "image/png", ".PNG").when(mime == "video/mp4", ".mp4").otherwise(".txt")
    files = table(spark, sf_dir, "pages").select(F.concat(F.lpad(F.col("page_id").cast("string"), 7, "0"), extension).alias("file"), F.concat(F.unhex(mark), F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("content"))
    folder = scratch(spark, "media")
    blobs.write_blobs(files, folder)
    return loading.scan(spark, folder)
