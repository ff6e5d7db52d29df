"""Scalar functions, planning constants, chunks, images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import schedule, text
from rasterweave.sources import images
from rasterweave.sources.session import scratch
from rasterweave.streaming import chunks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("name", "base"), [("My photo.v2.png", "My-photo-v2"), ("--a__b--.jpg", "a__b"), ("...", "line-art"), ("", "line-art"), (None, "line-art"), ("é.png", "line-art"), ("x", "x"), ("a.b\n", "a")])
def test_base_name(spark, name, base):
    assert one(spark, name, text.sanitize_base_name) == base


@pytest.mark.parametrize(("name", "ext"), [("a.mov", ".mov"), ("a.b.c", ".c"), ("noext", ".mp4"), ("dot.", ".")])
def test_extension(spark, name, ext):
    assert one(spark, name, text.file_extension) == ext


@pytest.mark.parametrize(("n", "label"), [(0, "0 B"), (-5, "0 B"), (None, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (10240, "10 KB"), (5 * 1024**2, "5.0 MB"), (3 * 1024**4, "3072 GB")])
def test_size(spark, n, label):
    assert one(spark, n, text.format_file_size, "long") == label


@pytest.mark.parametrize(("raw", "color"), [("#A1b2C3", "#A1b2C3"), (" abc ", "#aabbcc"), ("#FfF", "#FFffFF"), ("rgb(300, 2 ,3)", "#ff0203"), ("RGB (1 2 3)", "#010203"), ("red", None), ("#12", None), (None, None)])
def test_color(spark, raw, color):
    assert one(spark, raw, text.parse_color) == color


@pytest.mark.parametrize(("w", "h", "frames"), [(1920, 1080, 600), (3840, 2160, 600), (4096, 4096, 500), (7680, 4320, 252), (1, 1, 600)])
def test_chunk_size(spark, w, h, frames):
    assert spark.range(1).select(schedule.chunk_size(F.lit(w), F.lit(h)).alias("r")).first().r == frames


def test_worker_memory(spark):
    assert spark.range(1).select(schedule.worker_mb(F.lit(1920), F.lit(1080)).alias("r")).first().r == 70


@pytest.mark.parametrize(("side", "want"), [(4095, 4095), (4096, 4096), (4097, 4096)])
def test_scaled_size(spark, side, want):
    w, h = schedule.scaled_size(F.lit(side), F.lit(10), F.lit(1.0), F.lit(False))
    assert spark.range(1).select(w.alias("w")).first().w == want


@pytest.mark.parametrize("n", [1, 59, 60, 61, 599, 600, 601])
def test_routes_cover_all_frames(spark, n):
    df = schedule.route(spark.range(n).withColumnRenamed("id", "i"), F.lit(n), F.lit(4), F.lit(60))
    rows = df.collect()
    assert len({(r.seg, r.chunk, r.within) for r in rows}) == n
    done = chunks.completed(df).collect()
    assert sum(r.frames for r in done) == n
    assert len(done) == len({(r.seg, r.chunk) for r in rows})


def test_stream_fires_each_chunk_once_in_any_order(spark):
    rng = np.random.default_rng(3)
    src, out = scratch(spark, "in"), scratch(spark, "out")
    df = schedule.route(spark.range(300).withColumnRenamed("id", "i"), F.lit(300), F.lit(2), F.lit(60)).select("seg", "chunk", "within", "expected")
    rows = [tuple(r) for r in df.collect()]
    rng.shuffle(rows)
    rows += rows[:90]  # repeats, some of them late
    for k in range(3):  # three files, so three micro-batches
        spark.createDataFrame(rows[k::3], df.schema).coalesce(1).write.mode("append").parquet(src)
    stream = chunks.frame_stream(spark, src, df.schema, most_files=1)
    q = chunks.completed_stream(stream).writeStream.option("checkpointLocation", out + "/state").trigger(availableNow=True)
    q.format("parquet").option("path", out + "/rows").start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(chunks.OUT).parquet(out + "/rows").collect()))
    assert got == sorted(map(tuple, chunks.completed(spark.createDataFrame(rows, df.schema)).collect()))


def test_png_files_read_back(spark):
    rng = np.random.default_rng(6)
    data = {i: rng.integers(0, 256, (4 + i, 5, 3)).astype(np.uint8) for i in range(3)}
    frames = spark.createDataFrame([(i, 5, 4 + i, bytearray(a.tobytes())) for i, a in data.items()], "frame_id long, width int, height int, rgb binary")
    folder = scratch(spark, "png")
    assert images.write_png_files(frames, folder).count() == 3
    open(folder.removeprefix("file://") + "/broken.png", "wb").write(b"no image")
    read = images.read_images(spark, folder).where("readable").withColumn("i", F.regexp_extract("path", r"frame-(\d+)", 1).cast("long"))
    back = {i: np.zeros_like(a) for i, a in data.items()}
    for r in images.image_pixels(read, "i").collect():
        back[r.i][r.y, r.x] = (r.r, r.g, r.b)
    assert all((back[i] == data[i]).all() for i in data)


def test_chunk_table_is_partitioned(spark):
    df = schedule.route(spark.range(130).withColumnRenamed("id", "i"), F.lit(130), F.lit(2), F.lit(60)).withColumn("png", F.encode(F.lit("x"), "utf-8"))
    path = scratch(spark, "chunks")
    images.write_chunks(df, path)
    back = spark.read.parquet(path)
    assert back.where("seg = 1 and chunk = 0").count() == 60
    assert back.where("seg = 1 and chunk = 0 and within = 3").first().path == "seg1/c0/frame-00003.png"


def test_chunk_table_has_a_folder_for_many_chunks(spark):
    n = 60 * 600
    df = schedule.route(spark.range(n).withColumnRenamed("id", "i"), F.lit(n), F.lit(2), F.lit(60)).withColumn("png", F.encode(F.lit("x"), "utf-8"))
    path = scratch(spark, "chunks")
    images.write_chunks(df, path)
    back = spark.read.parquet(path)
    assert len(back.inputFiles()) == 4  # 300 chunks a segment
    assert back.groupBy("seg", "chunk").count().where("count = 60").count() == 600


def test_observed_progress(spark):
    from rasterweave.streaming import progress

    df, seen = progress.observed(spark.range(40).withColumnRenamed("id", "frame_id"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"done": 40, "latest": 39}
    assert progress.percent(40, 40) == 88 and progress.percent(0, 40) == 5


def test_stream_resumes_from_its_checkpoint(spark):
    """Stopping between files and starting again fires no chunk twice and loses none."""
    src, out = scratch(spark, "in"), scratch(spark, "out")
    df = schedule.route(spark.range(120).withColumnRenamed("id", "i"), F.lit(120), F.lit(1), F.lit(60)).select("seg", "chunk", "within", "expected")
    for part in ("within % 2 = 0", "within % 2 = 1"):
        df.where(part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        q = chunks.completed_stream(stream).writeStream.option("checkpointLocation", out + "/state").trigger(availableNow=True)
        q.format("parquet").option("path", out + "/rows").start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(chunks.OUT).parquet(out + "/rows").collect()))
    assert got == [(0, 0, 60), (0, 1, 60)]


def test_repeated_frames_do_not_complete_a_chunk(spark):
    src, out = scratch(spark, "in"), scratch(spark, "out")
    rows = [(0, 0, 0, 3), (0, 0, 0, 3), (0, 0, 1, 3), (0, 1, 0, 1), (0, 1, 0, 1)]
    df = spark.createDataFrame(rows, "seg long, chunk long, within long, expected long")
    df.coalesce(1).write.parquet(src)
    q = chunks.completed_stream(chunks.frame_stream(spark, src, df.schema)).writeStream.option("checkpointLocation", out + "/state").trigger(availableNow=True)
    q.format("parquet").option("path", out + "/rows").start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(chunks.OUT).parquet(out + "/rows").collect()))
    assert got == sorted(map(tuple, chunks.completed(df).collect())) == [(0, 1, 1)]


@pytest.mark.parametrize("run", [4096, 16])
def test_clock_keeps_events_without_a_time(spark, tmp_path, monkeypatch, run):
    from rasterweave.sources import rasters
    from rasterweave.sources.rasters import frame_clock

    monkeypatch.setattr(rasters, "UNTIMED", run)

    rows = [(i, None if i % 10 == 0 else f"2024-01-0{1 + i % 3} 00:00:{i:02d}", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"file://{tmp_path}/events.parquet")
    got = frame_clock(spark, f"file://{tmp_path}").orderBy("i").collect()
    assert [r.i for r in got] == list(range(50)) and [r.event_id for r in got[-5:]] == [0, 10, 20, 30, 40]
