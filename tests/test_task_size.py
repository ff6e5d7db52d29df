"""A render's tasks are as many as keep their pixels, however well these compress."""

from pyspark.sql import functions as F

from rasterweave.operators import lineart, stencil, tiling
from rasterweave.plans import model, raster_queries
from rasterweave.sources.session import scratch


def vectors(spark, n):
    folder = scratch(spark, "vectors")
    spark.range(n).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.25).cast("float"), 64).alias("embedding")).write.parquet(folder + "/embeddings.parquet")
    return folder


def test_tasks_grow_with_the_table(spark):
    folder = vectors(spark, 64 * 170)  # 696,320 pixels, which compress to little
    most = []
    for px in (raster_queries.m64(spark, folder), raster_queries.g8(spark, folder)):
        sizes = [r["count"] for r in px.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 64 * 64 * 170
        most.append(max(sizes))
    assert max(most) < 3 * stencil.TASK


def test_renders_and_tiles_pass_the_number_on(spark):
    px = spark.range(64).select(F.lit(0).cast("long").alias("frame_id"), F.expr("cast(id div 8 as int)").alias("y"), F.expr("cast(id % 8 as int)").alias("x"), *[F.lit(9).alias(c) for c in "rgb"])
    parts = lambda df: df.rdd.getNumPartitions()
    assert parts(stencil.by_frame(px, 20 * stencil.TASK)) == 20
    assert parts(tiling.Tiles(4, 20 * stencil.TASK).local(px, 2, lambda p: p)) == 80
    plain = model.Settings(preset=model.preset("custom"), custom=True, bilateral=False, auto_normalize=False, clean_speckles=False, merge_double_edge=False)
    assert parts(lineart.line_art(px, plain, pixels=20 * stencil.TASK)) == 20
