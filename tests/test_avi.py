"""Containers of PNG frames: joined without decoding, read by seeking."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.sources import avi, images, session


def pictures(n, w=6, h=4):
    rng = np.random.default_rng(n)
    return [images.png(w, h, rng.integers(0, 256, w * h * 3).astype(np.uint8).tobytes()) for _ in range(n)]


def test_a_file_is_read_as_written():
    frames = [*pictures(5), b"odd"]
    data = avi.muxed(frames, 6, 4, 12.5)
    found = avi.opened(data)
    assert (found.width, found.height, found.fps, found.frames) == (6, 4, 12.5, 6)
    assert struct.unpack("<I", data[4:8])[0] == len(data) - 8
    entries = avi.entries_of(data[avi.HEADER + found.payload + 8 :])
    assert [data[avi.HEADER + at + 8 :][:size] for at, size in entries] == frames
    for at, size in entries:  # every entry points at a frame's chunk
        assert data[avi.HEADER + at :][:8] == b"00dc" + struct.pack("<I", size)
    for bad in (b"", data[:100], b"x" * 300):
        with pytest.raises(ValueError):
            avi.opened(bad)
    with pytest.raises(ValueError, match="4 GB"):
        avi.header(1, 1, 1.0, 1, 1 << 32)


def chunk_files(spark, n, per_chunk):
    png = pictures(n)
    rows = [(k // (3 * per_chunk), k // per_chunk, k, 6, 4, bytearray(p)) for k, p in enumerate(png)]
    df = spark.createDataFrame(rows, "seg long, chunk long, within long, width int, height int, png binary").repartition(5)
    return png, avi.mux_chunks(df, ["seg", "chunk"], 12.0)


def folder_of(spark):
    folder = session.scratch(spark, "avi")
    return folder, folder.removeprefix("file://")


def test_joined_files_equal_one_made_of_all_frames(spark):
    png, files = chunk_files(spark, 47, 5)
    folder, path = folder_of(spark)
    sizes = {r.seg: r.bytes for r in avi.write_joined(avi.join_chunks(files, "seg", ["chunk"]), "seg", ["chunk"], folder).collect()}
    assert sorted(os.listdir(path)) == sorted([f"{s}.avi" for s in range(4)]) or all(n.endswith((".avi", ".crc")) for n in os.listdir(path))
    for seg in range(4):
        data = open(f"{path}/{seg}.avi", "rb").read()
        assert data == avi.muxed(png[seg * 15 : seg * 15 + 15], 6, 4, 12.0) and len(data) == sizes[seg]
    # segments join to the final file by the same step
    whole = spark.createDataFrame([("final", s, bytearray(open(f"{path}/{s}.avi", "rb").read())) for s in range(4)], "file string, seg long, avi binary")
    avi.write_joined(avi.join_chunks(whole, "file", ["seg"]), "file", ["seg"], folder + "/final").collect()
    assert open(f"{path}/final/final.avi", "rb").read() == avi.muxed(png, 6, 4, 12.0)


def test_frames_are_read_by_range(spark):
    png, files = chunk_files(spark, 23, 4)
    folder, _ = folder_of(spark)
    avi.write_joined(avi.join_chunks(files, "seg", ["chunk"]), "seg", ["chunk"], folder).collect()
    back = avi.read_frames(spark, folder, 5)
    assert back.rdd.getNumPartitions() == 3 + 3
    got = [(r.file, r.place, zlib.crc32(bytes(r.content))) for r in back.orderBy("file", "place").collect()]
    assert got == [(f"{k // 12}.avi", k % 12, zlib.crc32(p)) for k, p in enumerate(png)]


def test_a_failing_join_leaves_no_file(spark):
    _, files = chunk_files(spark, 10, 5)
    folder, path = folder_of(spark)
    other = spark.createDataFrame([(0, 9, bytearray(avi.muxed(pictures(1, 8, 8), 8, 8, 12.0)))], "seg long, chunk long, avi binary")
    with pytest.raises(Exception, match="different sizes"):
        avi.write_joined(avi.join_chunks(files.unionByName(other), "seg", ["chunk"]), "seg", ["chunk"], folder).collect()
    assert not os.path.exists(path) or os.listdir(path) == []
    assert avi.join_chunks(files.where("seg < 0"), "seg", ["chunk"]).count() == 0


@pytest.mark.parametrize(("kind", "channels"), images.CHANNELS.items())
def test_decoder_undoes_every_filter(kind, channels):
    rng = np.random.default_rng(kind)
    w, h = 7, 10
    px = rng.integers(0, 256, (h, w * channels)).astype(np.uint8)
    lines = b""
    for y in range(h):
        f, line, up = y % 5, px[y].astype(int), px[y - 1].astype(int) if y else np.zeros(w * channels, int)
        left = np.concatenate([np.zeros(channels, int), line[:-channels]])
        corner = np.concatenate([np.zeros(channels, int), up[:-channels]])
        guess = left + up - corner
        three = np.stack([left, up, corner])
        paeth = three[np.abs(three - guess).argmin(0), np.arange(w * channels)]
        lines += bytes([f]) + ((line - [0 * line, left, up, (left + up) // 2, paeth][f]) & 255).astype(np.uint8).tobytes()
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")
    got_w, got_h, got = images.unpng(data)
    want = px.reshape(h, w, channels)
    assert (got_w, got_h) == (w, h) and (got == (want[:, :, :3] if channels > 2 else want[:, :, :1])).all()
    for cut in (data[:-20], data[:40] + b"!" + data[41:], b"", data[:8]):
        with pytest.raises(ValueError):
            images.unpng(cut)
