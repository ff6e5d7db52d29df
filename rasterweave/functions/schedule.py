"""Frame times, segments, chunks, and resource planning."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024


def total_frames(duration, fps) -> Column:
    return F.greatest(F.lit(1), F.floor(duration * fps)).cast("long")


def frame_time(i, duration, fps) -> Column:
    return F.least(duration - 0.001, i / fps)


def preview_time(duration) -> Column:
    return F.least(F.greatest(duration * 0.2, F.lit(0.0)), F.greatest(F.lit(0.0), duration - 0.05))


def epoch_micros(df, c: str) -> Column:
    """Microseconds since 1970 of a time column, whatever the session's time zone."""
    if dict(df.dtypes)[c] == "timestamp_ntz":
        since = F.expr(f"cast({c} - timestamp_ntz'1970-01-01 00:00:00' as interval second)")
        return (since.cast("decimal(24,6)") * 1_000_000).cast("long")
    return F.unix_micros(F.col(c).cast("timestamp"))


def nearest_millis(micros: Column) -> Column:
    """Half a millisecond goes away from zero."""
    return F.round(micros.cast("decimal(20,0)") / 1000, 0).cast("long")


def segment_length(total, segments) -> Column:
    return F.ceil(total / segments).cast("long")


def route(df, total: Column, segments: Column, chunk: Column, i: str = "i"):
    """Adds seg, local, chunk, within and expected to each frame index."""
    df = df.withColumn("_n", total.cast("long")).withColumn("_s", segments.cast("long")).withColumn("_c", chunk.cast("long")).withColumn("_f", segment_length(F.col("_n"), F.col("_s")))
    df = df.withColumn("seg", F.least(F.col("_s") - 1, F.expr(f"{i} div _f"))).withColumn("local", F.col(i) - F.col("seg") * F.col("_f"))
    own = F.when(F.col("seg") == F.col("_s") - 1, F.col("_n") - F.col("seg") * F.col("_f")).otherwise(F.col("_f"))
    df = df.withColumn("chunk", F.expr("local div _c")).withColumn("within", F.expr("local % _c")).withColumn("_own", own)
    expected = F.least(F.expr("(local div _c) * _c + _c"), F.col("_own")) - F.expr("(local div _c) * _c")
    return df.withColumn("expected", expected).drop("_n", "_s", "_c", "_f", "_own")


def scaled_size(width, height, scale, custom) -> tuple[Column, Column]:
    """Target size: longest side at most 4096 unless custom, never above 1 : 1."""
    side = F.greatest(width, height)
    cap = F.when(~custom & (side > 4096), F.lit(4096) / side).otherwise(F.lit(1.0))
    ratio = F.least(F.lit(1.0), scale * cap)
    return tuple(F.greatest(F.lit(1), F.floor(n * ratio + 0.5)).cast("int") for n in (width, height))


def even(n) -> Column:
    return (n - n % 2).cast("int")


def chunk_size(width, height) -> Column:
    """Frames whose estimated PNG bytes fit 400 MiB, 60 to 600."""
    frames = F.floor(F.lit(400.0 * MIB) / F.greatest(width * height * 0.05, F.lit(1024.0)))
    return F.greatest(F.lit(60), F.least(F.lit(600), frames)).cast("int")


def _by_memory(memory_gb, each_mb, most) -> Column:
    free = F.greatest(F.lit(0.0), memory_gb * 1024 * 0.65 - 300)
    return F.when(memory_gb.isNotNull() & (memory_gb < 8), F.greatest(F.lit(1), F.floor(free / each_mb))).otherwise(most)


def workers(cores, memory_gb) -> Column:
    most = F.greatest(F.lit(1), cores - 2)
    return F.least(most, _by_memory(memory_gb, 80, most), F.lit(4)).cast("int")


def worker_mb(width, height) -> Column:
    return F.ceil(width * height * 4 / MIB * 5 + 30).cast("int")


def workers_for(width, height, cores, memory_gb) -> Column:
    most = F.greatest(F.lit(1), cores - 2)
    return F.least(most, _by_memory(memory_gb, worker_mb(width, height), most), F.lit(4)).cast("int")


def encoders(frames, cores, memory_gb) -> Column:
    memory = F.greatest(F.lit(1), F.floor((F.coalesce(memory_gb, F.lit(4.0)) * 1024 - 1024) / 250))
    fit = F.least(F.lit(4), memory, F.greatest(F.lit(1), cores - 1), F.floor(frames / 60))
    return F.when(frames < 60, 1).otherwise(fit).cast("int")


def threads_per_segment(cores, segments) -> Column:
    return F.greatest(F.lit(1), F.floor(cores / segments)).cast("int")


def progress(offset: int, scale: float, percent) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(offset) + F.floor(percent * scale + 0.5))).cast("int")


def chunk_path(seg, chunk, within) -> Column:
    return F.format_string("seg%d/c%d/frame-%05d.png", seg, chunk, within)


def advice(kind, megapixels, duration, frames) -> tuple[Column, Column]:
    """(tone, guidance) of a workload."""
    large = megapixels > 8
    image = F.when(large, "large image").otherwise("fine image")
    heavy = (duration > 60) | (frames > 1800) | large
    very = (duration > 7200) | (frames > 216000)
    video = F.when(very, "very long video").when(heavy, "heavy video").otherwise("fine video")
    tone = F.when(F.when(kind == "image", large).otherwise(heavy | very), "warn").otherwise("success")
    return tone, F.when(kind == "image", image).otherwise(video)
