"""Frames that fail and sources that cannot be read."""

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rasterweave.sources import blobs, images, loading, session
from rasterweave.streaming import failures


def halving():
    """A step that fails for two frames, as a closure: workers do not import this file."""

    def halve(row):
        if row["v"] in (30, 7):
            raise ValueError(f"corrupt frame {row['v']}")
        return {"half": row["v"] / 2}

    return halve


def frames(spark, n):
    return spark.range(n).select(F.col("id").alias("frame_id"), F.col("id").cast("int").alias("v"))


def test_a_batch_goes_on_and_raises_the_first_failure_by_index(spark):
    path = session.scratch(spark, "outcomes")
    with pytest.raises(failures.FrameError) as e:
        failures.settle(failures.attempted(frames(spark, 50).orderBy(F.desc("frame_id")), halving(), "half double"), path)
    assert (e.value.index, e.value.failed) == (7, 2) and "corrupt frame 7" in e.value.reason
    assert [tuple(r) for r in failures.report(spark, path).orderBy("frame_id").collect()] == [(7, "ValueError: corrupt frame 7"), (30, "ValueError: corrupt frame 30")]
    done = spark.read.parquet(path).where("error is null")
    assert done.count() == 48 and done.where("half = frame_id / 2").count() == 48


def test_no_failure_raises_nothing(spark):
    path = session.scratch(spark, "outcomes")
    failures.settle(failures.attempted(frames(spark, 5), halving(), "half double"), path)
    failures.settle(failures.attempted(frames(spark, 0), halving(), "half double"), path)
    assert failures.report(spark, path).count() == 0


def test_a_stream_stops_after_the_batch_that_has_a_failure(spark):
    src, out = session.scratch(spark, "in"), session.scratch(spark, "out")
    for part in ("v < 20", "v >= 20 and v < 40", "v >= 40"):
        frames(spark, 60).where(part).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema("frame_id long, v int").option("maxFilesPerTrigger", 1).parquet(src)
        sink = failures.attempted(stream, halving(), "half double").writeStream.foreachBatch(failures.settling(out + "/rows"))
        q = sink.option("checkpointLocation", out + "/state").trigger(availableNow=True).start()
        q.awaitTermination()

    for _ in range(2):  # the batch is replayed, and its report written anew
        with pytest.raises(StreamingQueryException, match="frame 7"):
            run()
        assert [r.frame_id for r in failures.report(spark, out + "/rows").collect()] == [7]
        assert spark.read.parquet(out + "/rows").count() == 20


def test_marks_and_names(spark):
    rows = [("a.PNG", b"\x89PNG\r\n\x1a\n.."), ("b.jpeg", b"\xff\xd8\xff\xe0"), ("c.webp", b"RIFF....WEBPVP8 "), ("d.mov", b"\0\0\0\x20ftypqt  "), ("e.mkv", b"\x1aE\xdf\xa3"), ("f.avi", b"RIFF....AVI LIST"), ("g.txt", b"BM"), ("h", b""), ("i.png", b"no")]
    folder = session.scratch(spark, "files")
    blobs.write_blobs(spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "file string, content binary"), folder)
    got = {r.file: r for r in loading.scan(spark, folder).collect()}
    assert [got[n].marked for n, _ in rows] == ["image", "image", "image", "video", "video", "video", "image", None, None]
    assert [got[n].named for n, _ in rows] == ["image", "image", "image", "video", "video", "video", None, None, "image"]
    assert [n for n, r in got.items() if r.first] == ["a.PNG"] and got["i.png"].kind == "image" and got["h"].kind is None


def test_sources_that_cannot_be_loaded_are_rows(spark):
    png = images.png(3, 2, np.zeros(18, np.uint8).tobytes())
    there = [("whole.png", png), ("cut.png", png[:30]), ("empty.png", b""), ("text.png", b"hello"), ("bad.avi", b"RIFF0000AVI nothing"), ("other.jpg", b"\xff\xd8\xff\xe0")]
    files = spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in there], "file string, length long, content binary")
    wanted = spark.createDataFrame([(n, 24.0 if n != "other.jpg" else 0.0, True) for n in [*[n for n, _ in there], "gone.png"]], "file string, fps double, has_audio boolean")
    got = {r.file: tuple(r)[1:] for r in loading.load(wanted, files, 18.0).collect()}
    lost = lambda why: (False, why, False, 18.0)
    assert got == {"whole.png": (True, None, True, 24.0), "cut.png": lost("damaged"), "empty.png": lost("empty"), "text.png": lost("unknown"), "bad.avi": lost("damaged"), "other.jpg": (True, None, True, 18.0), "gone.png": lost("missing")}
