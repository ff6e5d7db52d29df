"""Rasters, frame clocks, media and log lines derived from tables.

Pixel tables have frame_id, y, x and one column a plane. Gray rasters come from
one 64-number vector a frame (8 x 8), colour ones from three vectors in a row (r, g, b),
mosaics from 64 vectors (64 x 64); incomplete frames are left out.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FPS = 12.0
DURATION = 3600.0


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, e -> cast(e as double))").alias("e"))


def pixels(spark, sf_dir: str, vectors: int = 1) -> int:
    """How many pixels the rasters have at most, where a pixel takes a number of each of ``vectors``; from the files' metadata."""
    return 64 * table(spark, sf_dir, "embeddings").count() // vectors


def fixed_scale(e):
    """-0.6..0.6 to 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e + 0.6) / 1.2 * 255 + 0.5))).cast("int")


def gray8(spark, sf_dir: str) -> DataFrame:
    """(frame_id, y, x, v): each vector stretched to 0..255 (constant: 0)."""
    base = _values(spark, sf_dir).select("vec_id", "e", F.array_min("e").alias("lo"), F.array_max("e").alias("hi"))
    p = base.select(F.col("vec_id").alias("frame_id"), "lo", "hi", F.posexplode("e").alias("p", "e"))
    v = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("e") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255 + 0.5)).otherwise(0)
    return p.select("frame_id", F.expr("cast(p div 8 as int)").alias("y"), (F.col("p") % 8).alias("x"), v.cast("int").alias("v"))


def rgb8(spark, sf_dir: str) -> DataFrame:
    """(frame_id, y, x, r, g, b)."""
    base = _values(spark, sf_dir).select(F.expr("vec_id div 3").alias("frame_id"), (F.col("vec_id") % 3).alias("channel"), "e")
    frames = base.groupBy("frame_id").agg(*[F.max(F.when(F.col("channel") == k, F.col("e"))).alias(c) for k, c in enumerate("rgb")])
    frames = frames.where("r is not null and g is not null and b is not null")
    p = frames.select("frame_id", F.posexplode(F.arrays_zip("r", "g", "b")).alias("p", "c"))
    return p.select("frame_id", F.expr("cast(p div 8 as int)").alias("y"), (F.col("p") % 8).alias("x"), *[fixed_scale(F.col(f"c.{c}")).alias(c) for c in "rgb"])


def mosaic64(spark, sf_dir: str) -> DataFrame:
    """(frame_id, y, x, v): 64 vectors laid out 8 x 8."""
    base = _values(spark, sf_dir).select(F.expr("vec_id div 64").alias("frame_id"), (F.col("vec_id") % 64).alias("tile"), "e")
    whole = base.groupBy("frame_id").count().where("count = 64").select("frame_id")
    p = base.join(whole, "frame_id", "left_semi").select("frame_id", "tile", F.posexplode("e").alias("p", "e"))
    y = F.expr("cast(tile div 8 * 8 + p div 8 as int)")
    x = F.expr("cast(tile % 8 * 8 + p % 8 as int)")
    return p.select("frame_id", y.alias("y"), x.alias("x"), fixed_scale(F.col("e")).alias("v"))


#: Events without a time are counted in runs of this many ids.
UNTIMED = 4096


def frame_clock(spark, sf_dir: str) -> DataFrame:
    """(i, event_id, ts, value): events numbered in time order from 0.

    Ranks are counted within each minute and added to the minutes before, so no task holds
    all events; events without a time come last, by their ids, and are counted by runs of ids.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "value").withColumn("minute", F.date_trunc("minute", "ts"))
    e = e.withColumn("run", F.when(F.col("ts").isNull(), F.expr(f"event_id div {UNTIMED}")).otherwise(0))
    minutes = e.groupBy("minute", "run").count()
    before = Window.orderBy(F.asc_nulls_last("minute"), "run").rowsBetween(Window.unboundedPreceding, -1)  # one row a minute or run
    before = minutes.select(F.col("minute").alias("_minute"), F.col("run").alias("_run"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("minute", "run").orderBy(F.asc_nulls_last("ts"), "event_id"))
    joined = e.withColumn("rank", rank).join(before, F.col("minute").eqNullSafe(F.col("_minute")) & F.col("run").eqNullSafe(F.col("_run")))
    return joined.select((F.col("base") + F.col("rank") - 1).alias("i"), "event_id", "ts", "value")


def media_dims(spark, sf_dir: str) -> DataFrame:
    """(media_id, width, height, duration_s, detail, preset_no) from part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("media_id"),
        (F.col("p_size") * 64).cast("int").alias("width"),
        ((F.col("p_partkey") % 50 + 1) * 64).cast("int").alias("height"),
        (F.col("p_size") * 7.5).alias("duration_s"),
        (F.lit(35) + F.col("p_partkey") % 56).cast("int").alias("detail"),
        (F.col("p_partkey") % 6).cast("int").alias("preset_no"),
    )


#: DuckDB common table expressions of the same rasters.
G8 = """v0 AS (SELECT vec_id, unnest(range(64)) AS p, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS a FROM embeddings),
v1 AS (SELECT vec_id, p, a[p + 1] AS e, list_min(a) AS lo, list_max(a) AS hi FROM v0),
g8 AS (SELECT vec_id AS frame_id, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x,
       CAST(CASE WHEN hi > lo THEN floor((e - lo) / (hi - lo) * 255 + 0.5) ELSE 0 END AS INT) AS v FROM v1)"""

_SCALE = "CAST(least(255, greatest(0, floor((CAST({0} AS DOUBLE) + 0.6) / 1.2 * 255 + 0.5))) AS INT)"
RGB8 = f"""c0 AS (SELECT vec_id // 3 AS frame_id, vec_id % 3 AS ch, unnest(range(64)) AS p, embedding FROM embeddings),
c1 AS (SELECT frame_id, p, ch, {_SCALE.format('embedding[p + 1]')} AS v FROM c0),
rgb8 AS (SELECT frame_id, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x, max(CASE WHEN ch = 0 THEN v END) AS r,
         max(CASE WHEN ch = 1 THEN v END) AS g, max(CASE WHEN ch = 2 THEN v END) AS b FROM c1 GROUP BY frame_id, p HAVING count(*) = 3)"""
M64 = f"""m0 AS (SELECT vec_id // 64 AS frame_id, vec_id % 64 AS t, unnest(range(64)) AS p, embedding, count(*) OVER (PARTITION BY vec_id // 64) AS n FROM embeddings),
m64 AS (SELECT frame_id, CAST(t // 8 * 8 + p // 8 AS INT) AS y, CAST(t % 8 * 8 + p % 8 AS INT) AS x, {_SCALE.format('embedding[p + 1]')} AS v FROM m0 WHERE n = 64)"""
CLOCK = "clock AS (SELECT row_number() OVER (ORDER BY ts NULLS LAST, event_id) - 1 AS i, event_id, ts, value FROM events)"
DIMS = """dims AS (SELECT p_partkey AS media_id, CAST(p_size * 64 AS INT) AS width, CAST((p_partkey % 50 + 1) * 64 AS INT) AS height,
        p_size * 7.5::DOUBLE AS duration_s, CAST(35 + p_partkey % 56 AS INT) AS detail, CAST(p_partkey % 6 AS INT) AS preset_no FROM part)"""
