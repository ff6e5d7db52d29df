"""Files by listing: what they are by name and by content, and sources that cannot be read.

A source that is missing, empty or damaged does not end a run: it is a row that says why, with what is used
instead (the configured rate, no audio).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions import text
from rasterweave.sources import avi, blobs, images
from rasterweave.sources.session import ship

#: Kind, place and bytes of a format's mark (PNG, JPEG, GIF, BMP, WebP; ISO media, Matroska, AVI, Ogg).
MARKS = [
    ("image", 0, "89504E470D0A1A0A"), ("image", 0, "FFD8FF"), ("image", 0, "47494638"), ("image", 0, "424D"), ("image", 8, "57454250"),
    ("video", 4, "66747970"), ("video", 0, "1A45DFA3"), ("video", 8, "41564920"), ("video", 0, "4F676753"),
]
#: MIME types of extensions.
TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp",
    "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm", "mkv": "video/x-matroska", "avi": "video/x-msvideo", "ogv": "video/ogg",
}


def mime_of_name(name: Column) -> Column:
    """By the extension, whatever its case; null for others."""
    known = F.create_map(*[F.lit(v) for pair in TYPES.items() for v in pair])
    return known[F.lower(F.regexp_extract(name, r"\.([^./]*)\z", 1))]


def kind_of_content(content: Column) -> Column:
    """image or video by the format's mark, else null."""
    kind = F.lit(None).cast("string")
    for name, at, mark in reversed(MARKS):
        kind = F.when(F.hex(F.substring(content, at + 1, len(mark) // 2)) == mark, name).otherwise(kind)
    return kind


def scan(spark, folder: str) -> DataFrame:
    """(file, length, mime, named, marked, kind, first) of all files below ``folder``, empty ones too: the kind by MIME type and by
    content, of which the content's counts where known; first marks the first file by name."""
    named = blobs.read_blobs(spark, folder).select("file", "length", kind_of_content(F.col("content")).alias("marked"))
    named = named.withColumn("mime", mime_of_name(F.col("file"))).withColumn("named", text.media_kind(F.col("mime")))
    first = named.agg(F.min("file").alias("file")).withColumn("first", F.lit(True))  # one row
    named = named.join(F.broadcast(first), "file", "left")
    return named.select("file", "length", "mime", "named", "marked", F.coalesce("marked", "named").alias("kind"), F.coalesce("first", F.lit(False)).alias("first"))


def read_whole(files: DataFrame) -> DataFrame:
    """``files`` (file, length, content) with reason, null where the content could be read: PNG and AVI files are
    parsed, of others the mark has to be known."""
    ship(files.sparkSession)
    known = files.withColumn("reason", F.when(F.col("length") == 0, "empty").when(kind_of_content(F.col("content")).isNull(), "unknown"))

    def judge(batches):
        for batch in batches:
            reasons = []
            for data, reason in zip(batch["content"], batch["reason"]):
                try:
                    data = bytes(data)
                    if reason is None and data[:8] == b"\x89PNG\r\n\x1a\n":
                        images.unpng(data)
                    elif reason is None and data[:4] == b"RIFF" and data[8:12] == b"AVI ":
                        avi.opened(data)
                except (ValueError, images.zlib.error):
                    reason = "damaged"
                reasons.append(reason)
            yield pd.DataFrame({"file": batch["file"], "reason": reasons})

    return known.select("file", "content", "reason").mapInPandas(judge, "file string, reason string")


def load(wanted: DataFrame, files: DataFrame, fps: float = 30.0) -> DataFrame:
    """(file, loaded, reason, has_audio, fps) of each ``wanted`` (file, fps, has_audio), in ``files`` (file, length, content):
    one that cannot be loaded is played at the configured rate, without audio."""
    found = read_whole(files).select("file", F.lit(True).alias("_there"), "reason")
    out = wanted.join(found, "file", "left").withColumn("reason", F.when(F.col("_there").isNull(), "missing").otherwise(F.col("reason")))
    loaded = F.col("reason").isNull()
    return out.select("file", loaded.alias("loaded"), "reason", (loaded & F.col("has_audio")).alias("has_audio"), F.when(loaded & (F.col("fps") > 0), F.col("fps")).otherwise(F.lit(fps)).alias("fps"))
