"""The file source: what is committed, what a failed task leaves, what comes back."""

import os
import time

import pytest
from pyspark.sql import functions as F

from rasterweave.sources import blobs, session


def files(folder):
    root = folder.removeprefix("file://")
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def settled(folder, want):
    """The files once attempts that outlive a failed run have taken theirs with them."""
    for _ in range(100):
        if files(folder) == want:
            break
        time.sleep(0.1)
    return files(folder)


def some(spark, n, parts=4):
    df = spark.range(n).repartition(parts)
    return df.select(F.format_string("f-%03d.bin", "id").alias("file"), F.encode(F.concat(F.lit("content "), F.col("id").cast("string")), "utf-8").alias("content"), F.col("id"))


def test_round_trip_in_several_tasks(spark):
    folder = session.scratch(spark, "blobs")
    blobs.write_blobs(some(spark, 50), folder)
    back = blobs.read_blobs(spark, folder, 7)
    assert back.rdd.getNumPartitions() == 8
    rows = back.orderBy("file").collect()
    assert [r.file for r in rows] == [f"f-{i:03d}.bin" for i in range(50)]
    assert all(bytes(r.content) == f"content {i}".encode() and r.length == len(r.content) for i, r in enumerate(rows))
    assert all(p.startswith("part-") for p in files(folder))
    # Spark's own binary source sees the same files
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).count() == 50


def test_overwrite_replaces_and_append_adds(spark):
    folder = session.scratch(spark, "blobs")
    blobs.write_blobs(some(spark, 5), folder)
    blobs.write_blobs(some(spark, 9).where("id >= 5"), folder)
    assert blobs.read_blobs(spark, folder).count() == 9
    blobs.write_blobs(some(spark, 3), folder, "overwrite")
    assert [r.file for r in blobs.read_blobs(spark, folder).orderBy("file").collect()] == ["f-000.bin", "f-001.bin", "f-002.bin"]


def failing(bad):
    def run(batches):
        for b in batches:
            for k in range(len(b)):
                yield b.iloc[k : k + 1]
            if (b["file"] == bad).any():
                raise RuntimeError("killed in mid-write")

    return run


def test_a_failed_task_leaves_nothing(spark):
    folder = session.scratch(spark, "blobs")
    df = some(spark, 40).select("file", "content")
    with pytest.raises(Exception, match="killed in mid-write"):
        blobs.write_blobs(df.mapInPandas(failing("f-007.bin"), df.schema), folder)
    assert settled(folder, []) == []
    blobs.write_blobs(some(spark, 4), folder)
    before = files(folder)
    with pytest.raises(Exception, match="killed in mid-write"):
        blobs.write_blobs(df.mapInPandas(failing("f-007.bin"), df.schema), folder, "overwrite")
    assert settled(folder, before) == before and blobs.read_blobs(spark, folder).count() == 4


def test_an_attempt_that_is_not_committed_goes(spark):
    """Of two attempts of a task only the one whose message arrives is moved into place."""
    folder = session.scratch(spark, "blobs")
    writer = blobs.BlobWriter(folder, False)
    system, root = blobs.file_system(folder)
    staged = [f"{root}/{blobs.STAGING}/{writer.run}/part-00000-{writer.run}-{attempt}" for attempt in (1, 2)]
    for k, path in enumerate(staged):
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/a.bin") as out:
            out.write(b"attempt %d" % k)
    writer.commit([blobs.Written(staged[1], f"part-00000-{writer.run}", 1), None])
    assert [bytes(r.content) for r in blobs.read_blobs(spark, folder).collect()] == [b"attempt 1"] and len(files(folder)) == 1


def test_empty(spark):
    folder = session.scratch(spark, "blobs")
    blobs.write_blobs(some(spark, 4).where("id < 0"), folder)
    os.makedirs(folder.removeprefix("file://"), exist_ok=True)
    assert blobs.read_blobs(spark, folder).count() == 0
