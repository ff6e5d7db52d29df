"""Scalar functions on names, sizes and colours."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_base_name(name: Column) -> Column:
    """Last extension off; runs outside [A-Za-z0-9_-] become one dash; outer dashes off; empty: line-art."""
    base = F.regexp_replace(name, r"\.[^.]+\z", "")
    base = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9_-]+", "-"), r"\A-+|-+\z", "")
    return F.coalesce(F.nullif(base, F.lit("")), F.lit("line-art"))


def file_extension(name: Column) -> Column:
    """From the last dot on; .mp4 without one."""
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(".mp4")


def format_file_size(n: Column) -> Column:
    """0 B; B, KB, MB, GB by 1024; no decimals from 10 up or for bytes, else one, half up."""
    unit = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = n / F.pow(F.lit(1024.0), unit)
    name = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), unit + 1)
    whole = F.format_string("%d %s", F.floor(value + 0.5), name)
    tenth = F.floor(value * 10 + 0.5)
    one = F.format_string("%d.%d %s", F.floor(tenth / 10), (tenth % 10), name)
    return F.when(n.isNull() | (n <= 0) | F.isnan(n.cast("double")), "0 B").when((value >= 10) | (unit == 0), whole).otherwise(one)


def hex_to_rgb(c: Column) -> Column:
    """#rrggbb -> struct r, g, b."""
    v = F.conv(F.regexp_replace(c, "#", ""), 16, 10).cast("int")
    return F.struct(*[F.shiftright(v, k).bitwiseAND(F.lit(255)).alias(n) for n, k in (("r", 16), ("g", 8), ("b", 0))])


def parse_color(c: Column) -> Column:
    """#rrggbb, #rgb and rgb(r, g, b) forms as #rrggbb; else null."""
    s = F.trim(c)
    bare = F.regexp_replace(s, r"\A#", "")
    doubled = F.concat(F.lit("#"), F.regexp_replace(bare, "(.)", "$1$1"))
    form = r"(?i)\Argb\s*\(\s*(\d{1,3})(?:\s*,\s*|\s+)(\d{1,3})(?:\s*,\s*|\s+)(\d{1,3})\s*\)\z"
    parts = [F.lower(F.lpad(F.hex(F.least(F.lit(255), F.regexp_extract(s, form, k).try_cast("int")).cast("long")), 2, "0")) for k in (1, 2, 3)]
    return F.when(s.rlike(r"\A#?[0-9a-fA-F]{6}\z"), F.concat(F.lit("#"), bare)).when(s.rlike(r"\A#?[0-9a-fA-F]{3}\z"), doubled).when(s.rlike(form), F.concat(F.lit("#"), *parts))


def media_kind(mime: Column) -> Column:
    return F.when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video")


def mime_of(url: Column) -> Column:
    """A MIME type by the last letter class of a url's path: html pages count as
    images, numbered pages as video, others are unsupported."""
    path = F.regexp_extract(url, r"\A[^?#]*", 0)
    return F.when(path.endswith(".html"), "image/png").when(path.rlike(r"[0-9]\z"), "video/mp4").otherwise("text/plain")
