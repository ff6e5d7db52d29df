"""Frame-stream, scalar and planning queries, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterweave.functions import schedule as sch
from rasterweave.functions import text
from rasterweave.plans import model
from rasterweave.sources import images
from rasterweave.sources.rasters import CLOCK, DIMS, DURATION, FPS, frame_clock, media_dims, table
from rasterweave.sources.session import scratch, ship
from rasterweave.streaming import chunks, preview, segments

QUERIES, ORACLES = {}, {}
SEGMENTS, CHUNK = 4, 60


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


MIME = """CASE WHEN ends_with(regexp_extract(url, '^[^?#]*'), '.html') THEN 'image/png' WHEN regexp_matches(regexp_extract(url, '^[^?#]*'), '[0-9]$') THEN 'video/mp4' ELSE 'text/plain' END"""


@query(f"WITH m AS (SELECT page_id, {MIME} AS mime FROM pages) SELECT page_id, mime, CASE WHEN starts_with(mime, 'image/') THEN 'image' WHEN starts_with(mime, 'video/') THEN 'video' END AS kind FROM m")
def media_classify(spark, sf_dir):
    m = table(spark, sf_dir, "pages").select("page_id", text.mime_of(F.col("url")).alias("mime"))
    return m.withColumn("kind", text.media_kind(F.col("mime")))


SIZE = "least(1.0::DOUBLE, {1} * CASE WHEN NOT {2} AND greatest(width * 2, height * 2) > 4096 THEN 4096 / greatest(width * 2, height * 2) ELSE 1.0::DOUBLE END)"


def _size_sql(n):
    return f"CAST(greatest(1, floor({n} * 2 * {SIZE.format('', 'scale', 'custom')} + 0.5)) AS INT)"


SIZED = f"""{DIMS}, d AS (SELECT *, CASE media_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS scale, media_id % 5 = 0 AS custom FROM dims),
z AS (SELECT *, {_size_sql('width')} AS w, {_size_sql('height')} AS h FROM d)"""


def _sized(spark, sf_dir):
    d = media_dims(spark, sf_dir)
    scale = F.when(F.col("media_id") % 3 == 0, 1.0).when(F.col("media_id") % 3 == 1, 0.75).otherwise(0.5)
    d = d.withColumn("scale", scale).withColumn("custom", F.col("media_id") % 5 == 0)
    w, h = sch.scaled_size(F.col("width") * 2, F.col("height") * 2, F.col("scale"), F.col("custom"))
    return d.withColumn("w", w).withColumn("h", h)


@query(f"WITH {SIZED} SELECT media_id, w, h FROM z")
def scaled_size(spark, sf_dir):
    return _sized(spark, sf_dir).select("media_id", "w", "h")


@query(f"WITH {SIZED} SELECT media_id, CAST(w // 2 * 2 AS INT) AS w, CAST(h // 2 * 2 AS INT) AS h FROM z")
def even_dims(spark, sf_dir):
    z = _sized(spark, sf_dir)
    return z.select("media_id", sch.even(F.col("w")).alias("w"), sch.even(F.col("h")).alias("h"))


PRESET_ROWS = ", ".join(f"({i}, '{p[0]}', {p[3]}, {p[4]}, {p[6]})" for i, p in enumerate(model.PRESETS))


@query(f"""WITH {DIMS}, presets(k, preset, low0, high0, sigma0) AS (VALUES {PRESET_ROWS}),
a AS (SELECT media_id, preset, detail, CAST(greatest(12, floor(low0 / (detail / 62.0::DOUBLE) + 0.5)) AS INT) AS low, high0 / (detail / 62.0::DOUBLE) AS hi,
 CAST(greatest(20, floor(sigma0 * (0.75::DOUBLE + (detail - 35) / 100.0::DOUBLE) + 0.5)) AS INT) AS sigma FROM dims JOIN presets ON k = preset_no)
SELECT media_id, preset, low, CAST(greatest(low + 24, floor(hi + 0.5)) AS INT) AS high, sigma, CAST(greatest(15, floor(sigma * 0.5::DOUBLE + 0.5)) AS INT) AS refine FROM a""")
def preset_params(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in model.NAMES])
    d = media_dims(spark, sf_dir).withColumn("preset", F.element_at(names, F.col("preset_no") + 1))
    d = d.join(F.broadcast(model.preset_table(spark)), "preset")  # six rows
    return model.derived_parameters(d).select("media_id", "preset", "low", "high", "sigma", "refine")


TOTAL = int(FPS * DURATION)
FRAMES = f"{CLOCK}, fr AS (SELECT i, event_id, value FROM clock)"


@query(f"WITH {FRAMES} SELECT i, least({DURATION - 0.001}::DOUBLE, i / {FPS}::DOUBLE) AS t FROM fr")
def frame_schedule(spark, sf_dir):
    return frame_clock(spark, sf_dir).select("i", sch.frame_time(F.col("i"), F.lit(DURATION), F.lit(FPS)).alias("t"))


ROUTED = f"""{FRAMES}, n AS (SELECT count(*) AS total, CAST(ceil(count(*) / {SEGMENTS}) AS BIGINT) AS f FROM fr),
r0 AS (SELECT i, value, total, f, least({SEGMENTS - 1}, i // f) AS seg FROM fr, n),
r1 AS (SELECT *, i - seg * f AS local, CASE WHEN seg = {SEGMENTS - 1} THEN total - seg * f ELSE f END AS own FROM r0),
routed AS (SELECT i, value, CAST(seg AS BIGINT) AS seg, CAST(local AS BIGINT) AS local, CAST(local // {CHUNK} AS BIGINT) AS chunk, CAST(local % {CHUNK} AS BIGINT) AS within,
 CAST(least((local // {CHUNK}) * {CHUNK} + {CHUNK}, own) - (local // {CHUNK}) * {CHUNK} AS BIGINT) AS expected FROM r1)"""


def _routed(spark, sf_dir):
    total = table(spark, sf_dir, "events").count()  # from the files' metadata
    return sch.route(frame_clock(spark, sf_dir), F.lit(total), F.lit(SEGMENTS), F.lit(CHUNK))


@query(f"WITH {ROUTED} SELECT i, seg, local, chunk, within, expected FROM routed")
def segment_chunk_route(spark, sf_dir):
    return _routed(spark, sf_dir).select("i", "seg", "local", "chunk", "within", "expected")


#: Frames with a value below LOST never arrive, so some chunks stay incomplete; those above FAILED fail.
LOST, FAILED = 0.5, 150
ARRIVED = f"{ROUTED}, arrived AS (SELECT * FROM routed WHERE value >= {LOST})"


def _arrived(spark, sf_dir):
    return _routed(spark, sf_dir).where(f"value >= {LOST}")


@query(f"WITH {ARRIVED} SELECT seg, chunk, count(*) AS frames FROM arrived GROUP BY seg, chunk HAVING count(*) = max(expected)")
def chunk_complete(spark, sf_dir):
    return chunks.completed(_arrived(spark, sf_dir))


@query(f"WITH {ROUTED} SELECT i, seg, chunk FROM routed")
def interval_route_join(spark, sf_dir):
    """Frames joined to chunk intervals by bucketed start, equal to the arithmetic."""
    routed = _routed(spark, sf_dir)
    intervals = routed.groupBy("seg", "chunk").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    buckets = intervals.withColumn("bucket", F.explode(F.sequence(F.expr(f"first div {CHUNK}"), F.expr(f"last div {CHUNK}"))))
    f = frame_clock(spark, sf_dir).select("i", F.expr(f"i div {CHUNK}").alias("bucket"))
    return f.join(buckets, "bucket").where("i between first and last").select("i", "seg", "chunk")


@query(f"WITH {FRAMES}, n AS (SELECT count(*) AS total FROM fr) SELECT i, CAST(greatest(0, least(100, 88 + floor(least(100, 5 + (i + 1) / total * 83) * 0.04::DOUBLE + 0.5))) AS INT) AS percent FROM fr, n")
def progress_curve(spark, sf_dir):
    clock = frame_clock(spark, sf_dir)
    done = F.least(F.lit(100.0), 5 + (F.col("i") + 1) / F.lit(table(spark, sf_dir, "events").count()) * 83)
    return clock.select("i", sch.progress(88, 0.04, done).alias("percent"))


@query(f"WITH {ROUTED} SELECT seg, chunk, local, max(i) OVER (PARTITION BY seg, chunk ORDER BY value, i ROWS UNBOUNDED PRECEDING) AS latest FROM routed")
def latest_frame(spark, sf_dir):
    """The latest frame shown as a chunk's frames arrive in the order of value."""
    w = Window.partitionBy("seg", "chunk").orderBy("value", "i").rowsBetween(Window.unboundedPreceding, 0)
    return _routed(spark, sf_dir).select("seg", "chunk", "local", F.max("i").over(w).alias("latest"))


#: One log a user: every third line names a rate, every seventh a zero one.
LOGS = "logs AS (SELECT user_id, event_id AS line_no, CASE WHEN event_id % 7 = 0 THEN 'rate 0 fps' WHEN event_id % 3 = 0 THEN 'video: ' || (event_id % 60 + 1) || '.5 fps, ok' ELSE 'note ' || event_type END AS message FROM events)"


def _logs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rate = F.concat(F.lit("video: "), (F.col("event_id") % 60 + 1).cast("string"), F.lit(".5 fps, ok"))
    message = F.when(F.col("event_id") % 7 == 0, "rate 0 fps").when(F.col("event_id") % 3 == 0, rate).otherwise(F.concat(F.lit("note "), "event_type"))
    return e.select("user_id", F.col("event_id").alias("line_no"), message.alias("message"))


@query(f"WITH {LOGS}, m AS (SELECT user_id, line_no, TRY_CAST(nullif(regexp_extract(message, '([0-9]+(?:\\.[0-9]+)?) fps', 1), '') AS DOUBLE) AS fps FROM logs), "
       "l AS (SELECT user_id, arg_max(fps, line_no) FILTER (WHERE fps IS NOT NULL) AS fps FROM m GROUP BY 1) SELECT user_id, CASE WHEN fps > 0 THEN fps ELSE 30.0 END AS fps FROM l")
def fps_probe(spark, sf_dir):
    fps = F.nullif(F.regexp_extract("message", r"(\d+(?:\.\d+)?) fps", 1), F.lit("")).cast("double")
    m = _logs(spark, sf_dir).withColumn("fps", fps)
    last = m.groupBy("user_id").agg(F.max_by("fps", F.when(F.col("fps").isNotNull(), F.col("line_no"))).alias("fps"))
    return last.select("user_id", F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0).alias("fps"))


@query(f"WITH {LOGS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY line_no DESC) AS k FROM logs) SELECT user_id, line_no, message FROM r WHERE k <= 5")
def last_k_logs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("line_no"))
    return _logs(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")


@query(f"WITH {ROUTED} SELECT seg, chunk, min(i) AS first_index, arg_min(CASE WHEN value > {2 * FAILED} THEN 'encode' ELSE 'decode' END, i) AS reason FROM routed WHERE value > {FAILED} GROUP BY seg, chunk")
def first_failure(spark, sf_dir):
    failed = _routed(spark, sf_dir).where(f"value > {FAILED}").withColumn("reason", F.when(F.col("value") > 2 * FAILED, "encode").otherwise("decode"))
    return failed.groupBy("seg", "chunk").agg(F.min("i").alias("first_index"), F.min_by("reason", "i").alias("reason"))


@query("WITH v AS (SELECT o_orderkey AS media_id, o_totalprice / 100 AS video_s FROM orders), a AS (SELECT l_orderkey AS media_id, CAST(sum(l_quantity) AS DOUBLE) AS audio_s FROM lineitem WHERE l_quantity > 25 GROUP BY 1) "
       "SELECT media_id, audio_s IS NOT NULL AS has_audio, CAST(least(video_s, coalesce(audio_s, video_s)) AS DOUBLE) AS duration_s FROM v LEFT JOIN a USING (media_id)")
def audio_left_join(spark, sf_dir):
    """Optional audio: tracks (lines) of at most 25 are silent, so media of such lines alone have none."""
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media_id"), (F.col("o_totalprice") / 100).alias("video_s"))
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("media_id")).agg(F.sum("l_quantity").cast("double").alias("audio_s"))
    joined = v.join(a, "media_id", "left")
    return joined.select("media_id", F.col("audio_s").isNotNull().alias("has_audio"), F.least("video_s", F.coalesce("audio_s", "video_s")).cast("double").alias("duration_s"))


@query(f"WITH {ARRIVED}, done AS (SELECT seg, chunk FROM arrived GROUP BY seg, chunk HAVING count(*) = max(expected)) SELECT DISTINCT seg, chunk FROM routed EXCEPT SELECT seg, chunk FROM done")
def cleanup_anti(spark, sf_dir):
    """Chunks to clean up: expected ones that did not complete."""
    expected = _routed(spark, sf_dir).select("seg", "chunk").distinct()
    return expected.join(chunk_complete(spark, sf_dir), ["seg", "chunk"], "left_anti")


@query(f"WITH {ROUTED} SELECT seg, chunk, string_agg('file ''' || 'seg' || seg || '/c' || chunk || '/frame-' || lpad(CAST(within AS VARCHAR), 5, '0') || '.png''', chr(10) ORDER BY within) AS manifest, count(*) AS frames FROM routed GROUP BY seg, chunk")
def concat_manifest(spark, sf_dir):
    """Ordered concat lists; a chunk has at most 600 frames."""
    line = F.concat(F.lit("file '"), sch.chunk_path(F.col("seg"), F.col("chunk"), F.col("within")), F.lit("'"))
    parts = _routed(spark, sf_dir).select("seg", "chunk", F.struct("within", line.alias("line")).alias("p"))
    g = parts.groupBy("seg", "chunk").agg(F.array_sort(F.collect_list("p")).alias("p"), F.count("*").alias("frames"))
    return g.select("seg", "chunk", F.array_join("p.line", "\n").alias("manifest"), "frames")


@query(f"WITH {ROUTED}, a AS (SELECT seg, chunk, min(i) AS first_i FROM routed WHERE seg < 2 GROUP BY 1, 2 UNION ALL SELECT seg, chunk, min(i) FROM routed WHERE seg >= 2 GROUP BY 1, 2) SELECT seg, chunk, first_i, row_number() OVER (ORDER BY seg, chunk) AS place FROM a")
def ordered_concat(spark, sf_dir):
    """Bag union of two groups of segments with an explicit order: a chunk's
    place is its rank in its segment after all earlier segments' chunks."""
    c = _routed(spark, sf_dir).groupBy("seg", "chunk").agg(F.min("i").alias("first_i"))
    u = c.where("seg < 2").unionByName(c.where("seg >= 2"))
    per = u.groupBy("seg").count()
    before = per.select("seg", F.coalesce(F.sum("count").over(Window.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a segment
    return u.join(F.broadcast(before), "seg").select("seg", "chunk", "first_i", (F.col("base") + F.col("chunk") + 1).alias("place"))


@query(f"WITH {ROUTED}, a AS (SELECT CAST(avg(l_quantity) AS DOUBLE) * 10 AS audio_s FROM lineitem) SELECT CAST(i AS BIGINT) AS place, 'seg' || seg || '/c' || chunk || '/frame-' || lpad(CAST(within AS VARCHAR), 5, '0') || '.png' AS path, audio_s IS NOT NULL AS has_audio "
       f"FROM routed LEFT JOIN a ON TRUE WHERE i / {FPS}::DOUBLE < coalesce(audio_s, i + 1)")
def final_manifest(spark, sf_dir):
    """One ordered manifest of all segments' chunks' frames; with audio, the shorter of the two ends it."""
    audio = table(spark, sf_dir, "lineitem").agg((F.avg("l_quantity").cast("double") * 10).alias("audio_s")).withColumn("_all", F.lit(1))
    r = _routed(spark, sf_dir).withColumn("_all", F.lit(1)).join(F.broadcast(audio), "_all", "left")  # one row
    r = r.where(F.col("i") / F.lit(FPS) < F.coalesce("audio_s", F.col("i") + 1))
    return r.select(F.col("i").alias("place"), sch.chunk_path(F.col("seg"), F.col("chunk"), F.col("within")).alias("path"), F.col("audio_s").isNotNull().alias("has_audio"))


@query(f"""WITH {CLOCK}, s AS (SELECT user_id, event_id, ts, value FROM events), probe AS (SELECT user_id, ts, event_id FROM events WHERE event_id % 10 = 0)
SELECT p.event_id, arg_max(s.event_id, (s.ts, s.event_id)) AS shown FROM probe p JOIN s ON s.user_id = p.user_id AND s.ts <= p.ts AND s.event_id % 10 <> 0 GROUP BY p.event_id""".replace(f"{CLOCK}, ", ""))
def frame_as_of(spark, sf_dir):
    """As-of: the latest source frame at or before each sampling time of a stream,
    by one window over both sides instead of a range join."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("probe", F.col("event_id") % 10 == 0)
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    source = F.when(~F.col("probe"), F.struct("ts", "event_id"))
    return e.withColumn("shown", F.max(source).over(w)).where("probe and shown is not null").select("event_id", F.col("shown.event_id").alias("shown"))


LAST = "regexp_extract(regexp_extract(url, '^[^?#]*'), '[^/]*$')"


def _names(spark, sf_dir):
    name = F.regexp_extract(F.regexp_extract("url", r"\A[^?#]*", 0), r"[^/]*\z", 0)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(" my "), name).alias("name"))


@query(f"WITH n AS (SELECT page_id, ' my ' || {LAST} AS name FROM pages) SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]+$', ''), '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'line-art') AS base FROM n")
def sanitize_name(spark, sf_dir):
    return _names(spark, sf_dir).select("page_id", text.sanitize_base_name(F.col("name")).alias("base"))


@query(f"WITH n AS (SELECT page_id, ' my ' || {LAST} AS name FROM pages) SELECT page_id, CASE WHEN contains(name, '.') THEN regexp_extract(name, '\\.[^.]*$') ELSE '.mp4' END AS ext FROM n")
def file_ext(spark, sf_dir):
    return _names(spark, sf_dir).select("page_id", text.file_extension(F.col("name")).alias("ext"))


@query("""WITH n AS (SELECT doc_id, (n_chars - 100) * (CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 900 ELSE 700000 END) AS b FROM documents),
u AS (SELECT doc_id, b, CASE WHEN b < 1024 THEN 0 WHEN b < 1048576 THEN 1 WHEN b < 1073741824 THEN 2 ELSE 3 END AS k FROM n), v AS (SELECT *, b / pow(1024, k) AS x, ['B', 'KB', 'MB', 'GB'][k + 1] AS unit FROM u)
SELECT doc_id, CASE WHEN b <= 0 THEN '0 B' WHEN x >= 10 OR k = 0 THEN CAST(CAST(floor(x + 0.5) AS BIGINT) AS VARCHAR) || ' ' || unit
 ELSE CAST(CAST(floor(x * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(x * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) || ' ' || unit END AS label FROM v""")
def format_size(spark, sf_dir):
    by = F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 900).otherwise(700000)
    return table(spark, sf_dir, "documents").select("doc_id", text.format_file_size((F.col("n_chars") - 100) * by).alias("label"))


COLOR = "CASE page_id % 5 WHEN 0 THEN ' #' || upper(substr(md5(url), 1, 6)) WHEN 1 THEN substr(md5(url), 1, 3) WHEN 2 THEN 'rgb(' || (page_id % 400) || ', ' || (page_id % 256) || ',7)' WHEN 3 THEN 'RGB (1 2 ' || (page_id % 90) || ')' ELSE 'red' END"


def _colors(spark, sf_dir):
    p, h = table(spark, sf_dir, "pages"), F.md5("url")
    k = F.col("page_id")
    s = lambda c: c.cast("string")
    c = F.when(k % 5 == 0, F.concat(F.lit(" #"), F.upper(F.substring(h, 1, 6)))).when(k % 5 == 1, F.substring(h, 1, 3)).when(k % 5 == 2, F.concat(F.lit("rgb("), s(k % 400), F.lit(", "), s(k % 256), F.lit(",7)"))).when(k % 5 == 3, F.concat(F.lit("RGB (1 2 "), s(k % 90), F.lit(")"))).otherwise("red")
    return p.select("page_id", c.alias("raw"))


@query(f"""WITH c AS (SELECT page_id, trim({COLOR}) AS s FROM pages), b AS (SELECT page_id, s, ltrim(s, '#') AS h, lower(s) AS l FROM c)
SELECT page_id, CASE WHEN regexp_full_match(s, '#?[0-9a-fA-F]{{6}}') THEN '#' || h WHEN regexp_full_match(s, '#?[0-9a-fA-F]{{3}}') THEN '#' || h[1] || h[1] || h[2] || h[2] || h[3] || h[3]
 WHEN page_id % 5 = 2 THEN '#' || printf('%02x%02x07', least(255, page_id % 400), page_id % 256) WHEN page_id % 5 = 3 THEN '#' || printf('0102%02x', page_id % 90) END AS color FROM b""")
def parse_color(spark, sf_dir):
    return _colors(spark, sf_dir).select("page_id", text.parse_color(F.col("raw")).alias("color"))


@query("WITH h AS (SELECT page_id, substr(md5(url), 1, 6) AS h FROM pages) SELECT page_id, CAST('0x' || substr(h, 1, 2) AS INT) AS r, CAST('0x' || substr(h, 3, 2) AS INT) AS g, CAST('0x' || substr(h, 5, 2) AS INT) AS b FROM h")
def hex_to_rgb(spark, sf_dir):
    c = table(spark, sf_dir, "pages").select("page_id", text.hex_to_rgb(F.concat(F.lit("#"), F.substring(F.md5("url"), 1, 6))).alias("c"))
    return c.select("page_id", "c.r", "c.g", "c.b")


@query(f"""WITH {SIZED}, a AS (SELECT media_id, CASE WHEN media_id % 2 = 0 THEN 'image' ELSE 'video' END AS kind, w * h / 1000000.0::DOUBLE AS mp, duration_s * 40 AS dur FROM z), f AS (SELECT *, CAST(greatest(1, floor(dur * 18)) AS BIGINT) AS frames FROM a)
SELECT media_id, frames, CASE WHEN kind = 'image' THEN CASE WHEN mp > 8 THEN 'warn' ELSE 'success' END WHEN dur > 60 OR frames > 1800 OR mp > 8 THEN 'warn' ELSE 'success' END AS tone,
 CASE WHEN kind = 'image' THEN CASE WHEN mp > 8 THEN 'large image' ELSE 'fine image' END WHEN dur > 7200 OR frames > 216000 THEN 'very long video' WHEN dur > 60 OR frames > 1800 OR mp > 8 THEN 'heavy video' ELSE 'fine video' END AS guidance FROM f""")
def workload_advice(spark, sf_dir):
    z = _sized(spark, sf_dir).withColumn("kind", F.when(F.col("media_id") % 2 == 0, "image").otherwise("video"))
    z = z.withColumn("mp", F.col("w") * F.col("h") / 1000000).withColumn("dur", F.col("duration_s") * 40).withColumn("frames", sch.total_frames(F.col("dur"), F.lit(18.0)))
    tone, guidance = sch.advice(F.col("kind"), F.col("mp"), F.col("dur"), F.col("frames"))
    return z.select("media_id", "frames", tone.alias("tone"), guidance.alias("guidance"))


HARDWARE = "hw AS (SELECT *, media_id % 12 + 1 AS cores, CASE WHEN media_id % 4 = 0 THEN NULL ELSE (media_id % 4 * 2.0)::DOUBLE END AS gb FROM z)"


def _hardware(spark, sf_dir):
    gb = F.when(F.col("media_id") % 4 != 0, (F.col("media_id") % 4 * 2.0).cast("double"))
    return _sized(spark, sf_dir).withColumn("cores", F.col("media_id") % 12 + 1).withColumn("gb", gb)


def _memory_sql(each):
    return f"CASE WHEN gb < 8 THEN greatest(1, floor(greatest(0, gb * 1024 * 0.65::DOUBLE - 300) / {each})) ELSE greatest(1, cores - 2) END"


@query(f"""WITH {SIZED}, {HARDWARE}, e AS (SELECT *, CAST(ceil(w * h * 4 / 1048576.0::DOUBLE * 5 + 30) AS INT) AS worker_mb FROM hw)
SELECT media_id, CAST(least(greatest(1, cores - 2), {_memory_sql('80')}, 4) AS INT) AS workers, worker_mb, CAST(least(greatest(1, cores - 2), {_memory_sql('worker_mb')}, 4) AS INT) AS sized_workers FROM e""")
def worker_plan(spark, sf_dir):
    w, h, c, m = (F.col(x) for x in ("w", "h", "cores", "gb"))
    return _hardware(spark, sf_dir).select("media_id", sch.workers(c, m).alias("workers"), sch.worker_mb(w, h).alias("worker_mb"), sch.workers_for(w, h, c, m).alias("sized_workers"))


@query(f"""WITH {SIZED}, {HARDWARE}, f AS (SELECT *, CAST(greatest(1, floor(duration_s * 18)) AS BIGINT) AS frames FROM hw),
e AS (SELECT *, CAST(CASE WHEN frames < 60 THEN 1 ELSE least(4, greatest(1, floor((coalesce(gb, 4) * 1024 - 1024) / 250)), greatest(1, cores - 1), floor(frames / 60)) END AS INT) AS encoders FROM f)
SELECT media_id, frames, encoders, CAST(greatest(60, least(600, floor(419430400.0::DOUBLE / greatest(w * h * 0.05::DOUBLE, 1024)))) AS INT) AS chunk_frames, CAST(greatest(1, floor(cores / encoders)) AS INT) AS threads,
 least(greatest(duration_s * 0.2::DOUBLE, 0), greatest(0, duration_s - 0.05::DOUBLE)) AS preview_s FROM e""")
def encode_plan(spark, sf_dir):
    z = _hardware(spark, sf_dir).withColumn("frames", sch.total_frames(F.col("duration_s"), F.lit(18.0)))
    z = z.withColumn("encoders", sch.encoders(F.col("frames"), F.col("cores"), F.col("gb")))
    return z.select("media_id", "frames", "encoders", sch.chunk_size(F.col("w"), F.col("h")).alias("chunk_frames"), sch.threads_per_segment(F.col("cores"), F.col("encoders")).alias("threads"), sch.preview_time(F.col("duration_s")).alias("preview_s"))


#: Of the cache key's 24 values those that presets and dims do not give, in their order.
_S = model.Settings()
FIXED_KEY = [_S.line_weight, int(_S.clean_speckles), _S.clean_intensity, int(_S.merge_double_edge), _S.merge_intensity, int(_S.color_edges), _S.color_low, _S.color_high, _S.color_line_weight, _S.color_softness, f"{_S.color_opacity:g}"]
PRESET_KEY = ", ".join(f"({i}, '{':'.join(map(str, (p[3], p[4], p[5], p[6], *p[1], *p[2])))}')" for i, p in enumerate(model.PRESETS))


@query(f"WITH {DIMS}, presets(k, own) AS (VALUES {PRESET_KEY}) SELECT media_id, concat_ws(':', width, height, detail, own, '{':'.join(map(str, FIXED_KEY))}') AS cache_key FROM dims JOIN presets ON k = preset_no")
def settings_key(spark, sf_dir):
    """Size, detail, the preset's values and those of the optional stages, joined by colons."""
    names = F.array(*[F.lit(n) for n in model.NAMES])
    d = media_dims(spark, sf_dir).withColumn("preset", F.element_at(names, F.col("preset_no") + 1))
    d = d.join(F.broadcast(model.preset_table(spark)), "preset")  # six rows
    values = ["width", "height", "detail", "low0", "high0", "diameter", "sigma0", *[f"{c}.{k}" for c in ("background", "ink") for k in "rgb"]]
    return d.select("media_id", F.concat_ws(":", *[F.col(c).cast("string") for c in values], *[F.lit(str(v)) for v in FIXED_KEY]).alias("cache_key"))


@query("SELECT event_id, 'job-' || epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS job_id FROM events")
def job_id(spark, sf_dir):
    """A job is named after the millisecond it starts in."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("us", sch.epoch_micros(e, "ts")).select("event_id", F.concat(F.lit("job-"), F.expr("us div 1000").cast("string")).alias("job_id"))


CHUNKS = (
    f"WITH {ROUTED} SELECT CAST(seg AS BIGINT) AS seg, CAST(chunk AS BIGINT) AS chunk, count(*) AS frames, min('seg' || seg || '/c' || chunk || '/frame-' || lpad(CAST(within AS VARCHAR), 5, '0') || '.png') AS first_path FROM routed GROUP BY ALL"
)


@query(CHUNKS)
def chunk_sink(spark, sf_dir):
    """Frames written as a table partitioned by segment and run of chunks, and read back by partition."""
    path = scratch(spark, "chunk-table")
    rows = _routed(spark, sf_dir).select("seg", "chunk", "within", F.encode(F.col("i").cast("string"), "utf-8").alias("png"))
    images.write_chunks(rows, path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("seg").cast("long").alias("seg"), F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("frames"), F.min("path").alias("first_path"))


STREAMED = f"""n AS (SELECT count(*) AS total, min(event_id) AS base, CAST(ceil(count(*) / {SEGMENTS}) AS BIGINT) AS f FROM events), r0 AS (SELECT event_id - base AS i, value, total, f, least({SEGMENTS - 1}, (event_id - base) // f) AS seg FROM events, n),
r1 AS (SELECT *, i - seg * f AS local, CASE WHEN seg = {SEGMENTS - 1} THEN total - seg * f ELSE f END AS own FROM r0),
r2 AS (SELECT CAST(seg AS BIGINT) AS seg, CAST(local // {CHUNK} AS BIGINT) AS chunk, least((local // {CHUNK}) * {CHUNK} + {CHUNK}, own) - (local // {CHUNK}) * {CHUNK} AS expected FROM r1 WHERE value >= {LOST})"""


@query(f"WITH {STREAMED} SELECT seg, chunk, count(*) AS frames FROM r2 GROUP BY seg, chunk HAVING count(*) = max(expected)")
def stream_chunk_complete(spark, sf_dir):
    """Structured Streaming: every chunk fires once when its last frame arrives;
    frames are events by id, read as a stream until all input is used."""
    ship(spark)
    batch = table(spark, sf_dir, "events")
    first = batch.agg(F.count("*").alias("total"), F.min("event_id").alias("base")).first()
    source = chunks.frame_stream(spark, sf_dir, batch.schema, "events.parquet")
    frames = source.select((F.col("event_id") - first.base).alias("i"), "value")
    routed = sch.route(frames, F.lit(first.total), F.lit(SEGMENTS), F.lit(CHUNK)).where(f"value >= {LOST}").select("seg", "chunk", "within", "expected")
    out = scratch(spark, "stream-chunks")
    sink = chunks.completed_stream(routed).writeStream.option("checkpointLocation", out + "/state").trigger(availableNow=True)
    sink.format("parquet").option("path", out + "/rows").start().awaitTermination()
    return spark.read.schema(chunks.OUT).parquet(out + "/rows")


@query(f"WITH {ARRIVED}, g AS (SELECT seg, chunk, count(*) AS frames, max(expected) AS expected FROM arrived GROUP BY 1, 2) "
       "SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY chunk) - 1 AS place, chunk, frames, frames = expected AS complete FROM g")
def stream_segment_order(spark, sf_dir):
    """Structured Streaming: chunks leave each segment in their order though frames arrive in any; the end of the input flushes the incomplete ones."""
    when = lambda i: F.timestamp_seconds(F.lit(1_700_000_000) + i / FPS)
    arrived = _arrived(spark, sf_dir).select("seg", "chunk", "within", "expected", when(F.col("i")).alias("t"), when(F.col("i") - F.col("local") + F.lit(TOTAL)).alias("ends"))
    out = scratch(spark, "stream-segments")
    # eight files in an order that has nothing to do with time, two a micro-batch
    arrived.repartition(8, F.xxhash64("seg", "chunk", "within")).write.parquet(out + "/in")
    segments.end_row(spark).write.mode("append").parquet(out + "/in")
    with segments.keyed_state(spark):
        source = spark.readStream.schema(segments.ROUTED).option("maxFilesPerTrigger", 2).parquet(out + "/in")
        sink = segments.segment_stream(source).writeStream.option("checkpointLocation", out + "/state").trigger(availableNow=True)
        sink.format("parquet").option("path", out + "/rows").start().awaitTermination()
    return spark.read.schema(segments.OUT).parquet(out + "/rows")


@query(f"WITH {ARRIVED} SELECT seg, max(i) AS i, arg_max(value, i) AS value FROM arrived GROUP BY seg")
def stream_preview(spark, sf_dir):
    """Structured Streaming: each segment shows its newest frame, though frames arrive in any order."""
    arrived = _arrived(spark, sf_dir).select("seg", "i", "value")
    out = scratch(spark, "stream-preview")
    arrived.repartition(6, F.xxhash64("i")).write.parquet(out + "/in")
    source = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 2).parquet(out + "/in")
    sink = source.writeStream.foreachBatch(preview.keep_newest(out + "/shown")).option("checkpointLocation", out + "/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return preview.shown(spark, out + "/shown").select("seg", "i", "value")


@query(f"WITH {ROUTED}, t AS (SELECT seg, chunk, i, least({DURATION - 0.001}::DOUBLE, (i // 3) / {FPS}::DOUBLE) AS t FROM routed), p AS (SELECT *, lag(t) OVER (PARTITION BY seg, chunk ORDER BY i) AS before FROM t) "
       "SELECT i, t, before IS NOT NULL AND abs(t - before) < 0.001 AS skipped FROM p")
def seek_plan(spark, sf_dir):
    """Seeks that a chunk's reader can leave out: it already is within a millisecond."""
    t = _routed(spark, sf_dir).withColumn("t", sch.frame_time(F.expr("i div 3"), F.lit(DURATION), F.lit(FPS)))
    before = F.lag("t").over(Window.partitionBy("seg", "chunk").orderBy("i"))
    return t.select("i", "t", F.coalesce(F.abs(F.col("t") - before) < 0.001, F.lit(False)).alias("skipped"))


@query("SELECT user_id, CAST(floor((max(epoch_ms(ts)) - min(epoch_ms(ts))) / 1000 + 0.5) AS BIGINT) AS elapsed_s FROM events GROUP BY user_id")
def elapsed_seconds(spark, sf_dir):
    """Between a user's first and last event, each to the nearest millisecond."""
    e = table(spark, sf_dir, "events")
    us = sch.epoch_micros(e, "ts")
    ms = sch.nearest_millis(F.max(us)) - sch.nearest_millis(F.min(us))
    return e.groupBy("user_id").agg(F.floor(ms / 1000 + 0.5).cast("long").alias("elapsed_s"))


SITE = "regexp_extract(url, '://([^/?#]*)', 1)"


@query(f"SELECT {SITE} AS site, min(url) AS first_url, count(*) AS listed FROM pages GROUP BY 1")
def first_file(spark, sf_dir):
    """Of each list of files only the first is taken."""
    site = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(site.alias("site")).agg(F.min("url").alias("first_url"), F.count("*").alias("listed"))


@query(f"WITH {DIMS}, f AS (SELECT media_id, media_id % 2 = 0 AS normalize, media_id % 3 = 0 AS boost, media_id % 5 = 0 AS clean, media_id % 7 <> 0 AS loaded FROM dims) "
       "SELECT media_id, CASE WHEN NOT (normalize OR boost OR clean) THEN 'pixel' WHEN loaded THEN 'frame' ELSE 'not ready' END AS tier FROM f")
def tier_plan(spark, sf_dir):
    """Renders that need frame statistics or components go to the frame tier."""
    k = F.col("media_id")
    needs = (k % 2 == 0) | (k % 3 == 0) | (k % 5 == 0)
    tier = F.when(~needs, "pixel").when(k % 7 != 0, "frame").otherwise("not ready")
    return media_dims(spark, sf_dir).select("media_id", tier.alias("tier"))


@query(f"WITH {ARRIVED}, done AS (SELECT DISTINCT seg, chunk FROM arrived WHERE within = expected - 1) SELECT i, seg, chunk FROM routed r WHERE EXISTS (SELECT 1 FROM done d WHERE d.seg = r.seg AND d.chunk = r.chunk)")
def drained_members(spark, sf_dir):
    """Frames of chunks in the set whose last frame has arrived (semi join)."""
    done = _arrived(spark, sf_dir).where("within = expected - 1").select("seg", "chunk").distinct()
    return _routed(spark, sf_dir).join(done, ["seg", "chunk"], "left_semi").select("i", "seg", "chunk")


@query(f"WITH {ARRIVED}, w AS (SELECT seg, chunk, i FROM routed EXCEPT ALL SELECT seg, chunk, i FROM arrived) SELECT seg, chunk, i FROM w")
def expected_minus_done(spark, sf_dir):
    """Bag difference: frames that never arrived."""
    columns = ("seg", "chunk", "i")
    return _routed(spark, sf_dir).select(*columns).exceptAll(_arrived(spark, sf_dir).select(*columns))
