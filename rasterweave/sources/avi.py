"""Chunk files of PNG frames in AVI containers, joined without decoding, read by seeking.

A chunk's frames become one file (``muxed``). A segment's chunk files are joined from their bytes: the frames'
bytes are taken as they are, and only the header and the index are made anew, each chunk's entries moved by the bytes
before it. The parts of a joined file are rows in order, so that one is never held whole; ``write_joined`` streams them.
The ``aviframes`` source reads files by their index, a task for a range of frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rasterweave.sources.blobs import file_system
from rasterweave.sources.session import ship

#: Fixed values of the format: the codec, a frame's chunk, the flags of a file with index and of a key frame.
CODEC, FRAME, HAS_INDEX, KEY = b"MPNG", b"00dc", 0x10, 0x10
HEADER = 224
LARGEST = (1 << 32) - 1


def header(width: int, height: int, fps: float, frames: int, payload: int) -> bytes:
    """All that stands before the frames; ``payload`` is the bytes of the frames' chunks."""
    rate = round(fps * 1000)
    main = struct.pack("<14I", round(1_000_000 / fps), 0, 0, HAS_INDEX, frames, 0, 1, 0, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", CODEC, 0, 0, 0, 0, 1000, rate, 0, frames, 0, -1, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    kind = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, CODEC, width * height * 3, 0, 0, 0, 0)
    part = lambda name, body: name + struct.pack("<I", len(body)) + body
    lists = part(b"LIST", b"hdrl" + part(b"avih", main) + part(b"LIST", b"strl" + part(b"strh", stream) + part(b"strf", kind)))
    size = 4 + len(lists) + 12 + payload + 8 + 16 * frames
    if size > LARGEST:
        raise ValueError("a file of more than 4 GB; join fewer chunks")
    return b"RIFF" + struct.pack("<I", size) + b"AVI " + lists + b"LIST" + struct.pack("<I", payload + 4) + b"movi"


def index(entries: list[tuple[int, int]], base: int = 0) -> bytes:
    """Index entries of (offset in the payload, size), moved by ``base``; offsets count from the movi mark."""
    return b"".join(struct.pack("<4sIII", FRAME, KEY, 4 + base + at, size) for at, size in entries)


def muxed(frames: list[bytes], width: int, height: int, fps: float) -> bytes:
    parts, entries, at = [], [], 0
    for f in frames:
        entries.append((at, len(f)))
        parts.append(FRAME + struct.pack("<I", len(f)) + f + b"\0" * (len(f) % 2))
        at += len(parts[-1])
    return header(width, height, fps, len(frames), at) + b"".join(parts) + b"idx1" + struct.pack("<I", 16 * len(frames)) + index(entries)


@dataclass
class Opened:
    """What a file's header says; payload bytes begin at ``HEADER``."""

    width: int
    height: int
    fps: float
    frames: int
    payload: int


def opened(head: bytes) -> Opened:
    """From a file's first ``HEADER`` bytes, as ``header`` makes them."""
    if len(head) < HEADER or head[:4] != b"RIFF" or head[8:12] != b"AVI " or head[HEADER - 4 : HEADER] != b"movi" or head[112:116] != CODEC:
        raise ValueError("no AVI file of PNG frames")
    width, height = struct.unpack("<II", head[64:72])
    scale, rate = struct.unpack("<II", head[128:136])
    (frames,) = struct.unpack("<I", head[48:52])
    return Opened(width, height, rate / scale, frames, struct.unpack("<I", head[HEADER - 8 : HEADER - 4])[0] - 4)


def entries_of(raw: bytes) -> list[tuple[int, int]]:
    return [(at - 4, size) for _, _, at, size in struct.iter_unpack("<4sIII", raw)]


def mux_chunks(frames: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """(keys, avi) from (keys, within, width, height, png): one file a chunk, frames in the order of ``within``.
    A chunk is a few hundred frames at most, as ``schedule.chunk_size`` bounds its bytes."""
    ship(frames.sparkSession)
    kinds = ", ".join(f"{k} {dict(frames.dtypes)[k]}" for k in keys)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("within")
        out = own[keys].iloc[:1].copy()
        out["avi"] = [muxed([bytes(b) for b in own["png"]], int(own["width"].iloc[0]), int(own["height"].iloc[0]), fps)]
        return out

    return frames.select(*keys, "within", "width", "height", "png").groupBy(*keys).applyInPandas(run, f"{kinds}, avi binary")


def join_chunks(files: DataFrame, file: str, order: list[str]) -> DataFrame:
    """(file, kind, order, bytes): the parts of each ``file``, joined of its chunk files in ``order``. Sorted by
    kind and order they are the header, the frames of each chunk, the index's mark, and each chunk's entries."""
    ship(files.sparkSession)
    at = [file, *order]

    def measure(batches):
        for b in batches:
            found = [opened(bytes(d[:HEADER])) for d in b.pop("head")]
            for c in ("width", "height", "fps", "frames", "payload"):
                b[c] = [getattr(f, c) for f in found]
            yield b

    kinds = ", ".join(f"{k} {dict(files.dtypes)[k]}" for k in at)
    sizes = files.select(*at, F.expr(f"substring(avi, 1, {HEADER})").alias("head")).mapInPandas(measure, f"{kinds}, width int, height int, fps double, frames long, payload long")
    # a row a chunk, without its bytes
    all_, before = Window.partitionBy(file), Window.partitionBy(file).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *at, "width", "height", "fps", "frames", "payload", F.coalesce(F.sum("payload").over(before), F.lit(0)).alias("base"),
        F.sum("payload").over(all_).alias("total"), F.sum("frames").over(all_).alias("all_frames"),
        F.max(F.struct("width", "height", "fps")).over(all_).alias("most"), F.min(F.struct("width", "height", "fps")).over(all_).alias("least"),
    )

    def parts(batches):
        for b in batches:
            for row in b.to_dict("records"):
                if row["most"] != row["least"]:
                    raise ValueError("chunks of different sizes or rates cannot be joined")
                own, out = {k: row[k] for k in at}, []
                body = HEADER + row["payload"]
                moved = index(entries_of(row["avi"][body + 8 : body + 8 + 16 * row["frames"]]), row["base"])
                if row["base"] == 0:
                    out.append({**own, "kind": 0, "bytes": header(row["width"], row["height"], row["fps"], row["all_frames"], row["total"])})
                    out.append({**own, "kind": 2, "bytes": b"idx1" + struct.pack("<I", 16 * row["all_frames"])})
                out += [{**own, "kind": 1, "bytes": row["avi"][HEADER:body]}, {**own, "kind": 3, "bytes": moved}]
                yield pd.DataFrame(out)

    return files.select(*at, "avi").join(sizes, at).mapInPandas(parts, f"{kinds}, kind int, bytes binary")


def write_joined(parts: DataFrame, file: str, order: list[str], folder: str) -> DataFrame:
    """Each file's parts streamed to ``folder``; (file, path, bytes) once it runs. A file has its name only
    when it is whole: an attempt writes under a name of its own and moves it at the end."""
    ship(parts.sparkSession)
    kind = dict(parts.dtypes)[file]

    def run(batches):
        from pyspark import TaskContext

        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        attempt, of, out, staged, size = TaskContext.get().taskAttemptId(), None, None, None, 0

        def done():
            out.close()
            system.move(staged, f"{root}/{of}.avi")
            return pd.DataFrame({file: [of], "path": [f"{of}.avi"], "bytes": [size]})

        try:
            for b in batches:
                for name, data in zip(b[file], b["bytes"]):
                    if out is not None and name != of:
                        yield done()
                        out = None
                    if out is None:
                        of, staged, size = name, f"{root}/.{name}-{attempt}", 0
                        out = system.open_output_stream(staged)
                    out.write(data)
                    size += len(data)
            if out is not None:
                yield done()
                out = None
        finally:
            if out is not None:
                out.close()
                system.delete_file(staged)

    return parts.repartition(file).sortWithinPartitions(file, "kind", *order).select(file, "bytes").mapInPandas(run, f"{file} {kind}, path string, bytes long")


@dataclass
class Range(InputPartition):
    """Frames of one read task: their file, the place of the first, and (offset, size) of each."""

    path: str
    file: str
    first: int
    places: list[tuple[int, int]]

    def __init__(self, path, file, first, places):
        self.path, self.file, self.first, self.places = path, file, first, places


class AviReader(DataSourceReader):
    def __init__(self, folder: str, per_task: int):
        self.folder, self.per_task = folder, per_task

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, root = file_system(self.folder)
        out = []
        for info in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
            if info.type != fs.FileType.File or info.base_name[0] in "._" or not info.base_name.endswith(".avi"):
                continue
            with system.open_input_file(info.path) as f:
                found = opened(f.read(HEADER))
                f.seek(HEADER + found.payload + 8)
                entries = entries_of(f.read(16 * found.frames))
            out += [Range(info.path, info.base_name, k, entries[k : k + self.per_task]) for k in range(0, len(entries), self.per_task)]
        return out or [Range("", "", 0, [])]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.places:
            return
        system, _ = file_system(self.folder)
        with system.open_input_file(partition.path) as f:
            for k, (at, size) in enumerate(partition.places):
                f.seek(HEADER + at + 8)
                yield partition.file, partition.first + k, f.read(size)


class AviFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "aviframes"

    def schema(self) -> str:
        return "file string, place long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return AviReader(self.options["path"], int(self.options.get("framesPerTask", 256)))


def read_frames(spark: SparkSession, folder: str, per_task: int = 256) -> DataFrame:
    """(file, place, content) of all frames of the AVI files in a folder, a task for ``per_task`` of them."""
    ship(spark)
    spark.dataSource.register(AviFrames)
    return spark.read.format("aviframes").option("framesPerTask", per_task).load(folder)
