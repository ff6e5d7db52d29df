"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of at most this many bytes is broadcast; above it Spark shuffles both sides.
BROADCAST_BYTES = 48 << 20


#: Characters of text that a Python task works on at a time.
SLICE = 1_000_000


def slices(texts, most: int = SLICE) -> Iterator[list]:
    """Whole texts, as many as make about ``most`` characters at a time."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


_kept: dict = {}


def kept(key, build):
    """What this Python worker keeps between tasks: one operator's model at a time.

    Workers serve one stage after another; what the last operator kept goes
    before another's is made.
    """
    if _kept.get("key") != key:
        release()
        _kept.update(key=key, value=build())
    return _kept["value"]


def release() -> None:
    """Drop what was kept and hand free memory back to the system."""
    _kept.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """``run`` over a task's batches; the worker that goes idle after it holds no memory."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


#: Bytes of an Arrow batch on its way to or from a Python worker, where the session allows more.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver did, and keep batches of texts small: a batch is
    held by the JVM, on the way, and by the worker, in each of an executor's tasks at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, "67108864b")).rstrip("b") or 0) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local
    session without one gets a temporary folder; on a cluster it has to be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and reread: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def make_folder(spark: SparkSession, folder: str) -> None:
    path, fs = _file_system(spark, folder)
    fs.mkdirs(path)


def remove(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    for f in df.inputFiles()[:1]:
        path, fs = _file_system(df.sparkSession, f)
        fs.delete(path.getParent(), True)


def small(df: DataFrame) -> bool:
    """Whether a materialised table's measured size lets it be broadcast: 16 bytes a
    row and 8 a number, and what its strings, binaries and arrays hold."""
    fixed, loose = 16, []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            loose.append(F.octet_length(f.name))
        elif kind == "array":
            each = f.dataType.elementType.typeName()
            own = F.size(f.name) * 8 if each != "string" else F.octet_length(F.concat_ws(" ", f.name)) + F.size(f.name) * 16
            loose.append(own)
        elif kind == "struct":
            fixed += 8 * len(f.dataType.fields)
            loose += [F.octet_length(f"{f.name}.{g.name}") for g in f.dataType.fields if g.dataType.typeName() == "string"]
        fixed += 8
    total = F.lit(0).cast("long")
    for c in loose:
        total = total + F.coalesce(F.sum(F.greatest(c, F.lit(0)).cast("long")), F.lit(0))
    return df.agg((F.count("*") * fixed + total).alias("n")).first().n <= BROADCAST_BYTES


def sized_join(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """Join with a materialised right side: broadcast while its measured size is
    within BROADCAST_BYTES, else a shuffled join."""
    return left.join(F.broadcast(right) if small(right) else right, on, how)


def smallest_hashes(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """Of each group the ``most`` rows with the smallest hashes of ``key``.

    Group sizes set a hash bound that about 2 * most + 64 rows of a group pass, so what
    is ranked in one place stays that small however large a group is.
    """
    sizes = materialise(rows.groupBy(group).agg(F.count("*").alias("_n")), "group-sizes")
    bound = F.least(F.lit(1.0), (2.0 * most + 64) / F.col("_n")) * (1 << 30)
    near = sized_join(rows, sizes, group, "inner").where(F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30)) < bound)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30)), key))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_n", "_rank")


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds. Least neighbours are aggregated with
    map-side combine and written first, so that the join with them is a broadcast while
    they are small and else one that adaptive execution splits for hot nodes.
    Each round is written to the shared folder. Nodes without links are absent.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    e = materialise(e.distinct(), "cc")
    last = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-least")
        large = (
            sized_join(both, least, "u", "inner")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # every node keeps a row: large-star of a node with smaller neighbours only
        # is carried by those neighbours
        large = materialise(large, "cc-large")
        lower = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        joined = sized_join(large, lower, "u", "inner")
        small = (
            joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = materialise(small, "cc")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for done in (least, large, lower, e):
            remove(done)
        e = new
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
