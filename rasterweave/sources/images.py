"""Image files to pixel tables, frames to PNG files and manifests."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from rasterweave.functions import schedule
from rasterweave.sources import blobs
from rasterweave.sources.session import ship


def read_images(spark, path: str) -> DataFrame:
    """(path, width, height, channels, data, readable): files that are no image are
    kept and marked. Folders below are read too."""
    image = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    return image.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data", (F.col("width") > 0).alias("readable"))


def image_pixels(images: DataFrame, key: str = "path") -> DataFrame:
    """One row a pixel: key, y, x, r, g, b; alpha is dropped. Data is BGR, BGRA or gray."""
    dots = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))
    p = images.where("readable").select(key, "width", "channels", "data", dots.alias("p"))
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(data, p * channels + {k}, 1)")), 16, 10).cast("int")
    gray = F.col("channels") == 1
    planes = [F.when(gray, byte(1)).otherwise(byte(k)).alias(c) for c, k in (("r", 3), ("g", 2), ("b", 1))]
    return p.select(key, F.expr("cast(p div width as int)").alias("y"), F.expr("cast(p % width as int)").alias("x"), *planes)


def frames_of(px: DataFrame) -> DataFrame:
    """Pixel table r, g, b -> (frame_id, width, height, rgb BINARY), row-major.

    Pixels of a frame are gathered where the frame's key is; a frame is one row."""
    dot = F.struct("y", "x", "r", "g", "b")
    g = px.groupBy("frame_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.array_sort(F.collect_list(dot)).alias("p"))
    hexed = F.array_join(F.transform("p", lambda d: F.concat(*[F.lpad(F.hex(d[c]), 2, "0") for c in "rgb"])), "")
    return g.select("frame_id", "width", "height", F.unhex(hexed).alias("rgb"))


def png(width: int, height: int, rgb: bytes) -> bytes:
    """An 8-bit RGB PNG file."""

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines, 6)) + part(b"IEND", b"")


def with_png(frames: DataFrame) -> DataFrame:
    """Frame rows (frame_id, width, height, rgb) with a png column for rgb."""
    ship(frames.sparkSession)

    def run(batches):
        for b in batches:
            b["png"] = [png(w, h, d) for w, h, d in zip(b["width"], b["height"], b["rgb"])]
            yield b[["frame_id", "width", "height", "png"]]

    return frames.mapInPandas(run, "frame_id long, width int, height int, png binary")


def write_png_files(frames: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """One PNG file a frame below ``folder`` (a URI all executors share), all or none; (frame_id, file, bytes) of what is there."""
    named = with_png(frames).select(F.format_string("frame-%05d.png", "frame_id").alias("file"), F.col("png").alias("content"))
    blobs.write_blobs(named, folder, mode)
    there = blobs.read_blobs(frames.sparkSession, folder)
    return there.select(F.regexp_extract("file", r"frame-(\d+)\.png\z", 1).cast("long").alias("frame_id"), "file", F.col("length").alias("bytes"))


def unpng(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels of 3 bytes) of an 8-bit PNG without interlace; a ValueError says what is wrong with other data."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG signature")
    at, packed, head = 8, [], None
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack(">I", data[at + 8 + n : at + 12 + n].ljust(4, b"\0"))[0] != zlib.crc32(kind + body):
            raise ValueError(f"part {kind.decode('latin-1')} is cut or damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    else:
        raise ValueError("the file ends early")
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("only 8-bit PNGs without interlace are read")
    w, h, step = head[0], head[1], CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if lines.size != h * (w * step + 1):
        raise ValueError("pixels are missing")
    lines = lines.reshape(h, w * step + 1)
    out = np.zeros((h, w * step), np.uint8)
    for y in range(h):
        unfilter(int(lines[y, 0]), lines[y, 1:], out[y - 1] if y else np.zeros(w * step, np.uint8), out[y], step)
    px = out.reshape(h, w, step)
    return w, h, np.ascontiguousarray(px[:, :, :3] if step > 2 else np.repeat(px[:, :, :1], 3, 2))


#: Bytes a pixel by PNG colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def unfilter(kind: int, line: np.ndarray, above: np.ndarray, to: np.ndarray, step: int) -> None:
    """Undo a PNG line's filter: none, left, above, their mean, or the one of three neighbours nearest to left + above - corner."""
    if kind == 0:
        to[:] = line
    elif kind == 1:
        to[:] = np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).ravel()
    elif kind == 2:
        to[:] = line + above
    elif kind in (3, 4):
        for k in range(len(line)):
            left = int(to[k - step]) if k >= step else 0
            up, corner = int(above[k]), int(above[k - step]) if k >= step else 0
            guess = (left + up) // 2 if kind == 3 else min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            to[k] = (int(line[k]) + guess) & 255
    else:
        raise ValueError(f"filter {kind} is unknown")


def png_frames(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with width, height and rgb instead of the PNG in ``content``."""
    ship(files.sparkSession)
    others = [f for f in files.schema.fields if f.name != content]
    kept = StructType([*others, StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("rgb", BinaryType())])

    def run(batches):
        for b in batches:
            found = [unpng(bytes(d)) for d in b.pop(content)]
            b["width"], b["height"] = [w for w, _, _ in found], [h for _, h, _ in found]
            b["rgb"] = [px.tobytes() for _, _, px in found]
            yield b

    return files.mapInPandas(run, kept)


def rgb_pixels(frames: DataFrame, *keys: str) -> DataFrame:
    """(keys, y, x, r, g, b) of frames (keys, width, height, rgb)."""
    dots = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(rgb, p * 3 + {k}, 1)")), 16, 10).cast("int")
    p = frames.select(*keys, "width", "rgb", dots.alias("p"))
    return p.select(*keys, F.expr("cast(p div width as int)").alias("y"), F.expr("cast(p % width as int)").alias("x"), byte(1).alias("r"), byte(2).alias("g"), byte(3).alias("b"))


#: Chunks to a folder of a chunk table.
CHUNK_RUN = 256


def write_chunks(routed_png: DataFrame, path: str) -> None:
    """Encoded frames as a table partitioned by segment and run of chunks, its files sorted by chunk. A folder a chunk would be one
    for every 60 frames; a run of ``CHUNK_RUN`` is a folder and a task, and readers of a chunk skip row groups by its number."""
    named = routed_png.withColumn("path", schedule.chunk_path(F.col("seg"), F.col("chunk"), F.col("within"))).withColumn("run", F.expr(f"chunk div {CHUNK_RUN}"))
    named.repartition("seg", "run").sortWithinPartitions("seg", "run", "chunk", "within").write.partitionBy("seg", "run").parquet(path)
