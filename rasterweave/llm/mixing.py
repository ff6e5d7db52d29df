"""Mixing sources to target weights by fitting budgets as subset sums.

Documents are counted by source and exact length. A source's budget is passes over all its
documents, and a rest. Of the rest every length first gets its share of all but some reserve, rounded down;
what that leaves is filled from the longest lengths until the reserve remains, and this is
a bounded knapsack over the counts that are left, solved by dynamic programming for the nearest sum. Documents
of a length are then taken by seeded hash, as many as their length's count says.

All planning works on counts, at most one for each distinct length of a source. Choosing
among a length's documents never ranks more than about RANKED of them in one place: their hashes are dealt
to buckets, whole buckets are taken by their counts, and only the bucket where the count ends is ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare, small

#: A document is taken at most MOST times.
MOST = 3
#: Words left for the dynamic program: RESERVE, or twice the longest document up to LARGEST.
RESERVE, LARGEST = 1 << 16, 1 << 20
RANKED = 10_000
WORD, SPACES = r"[^\x20\x09-\x0D]+", " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), SPACES, "")), F.lit(0)).cast("long")


def nearest_subset(lengths: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """How many documents of each length to take, ``left`` at most, for the sum nearest to ``rest``, the
    smaller of two: a bounded knapsack. Counts are split into powers of two, and each sum remembers
    the first part that reached it."""
    take = np.zeros(len(lengths), np.int64)
    usable = np.flatnonzero((left > 0) & (lengths > 0))
    if rest <= 0 or not len(usable):
        return take
    width = 2 * rest  # beyond it taking none is nearer
    by = np.full(width + 1, -1, np.int32)
    reached = np.zeros(width + 1, bool)
    reached[0] = True
    parts: list[tuple[int, int]] = []
    for k in np.random.default_rng(len(usable)).permutation(usable).tolist():  # not the short ones first
        n, many = int(lengths[k]), 1
        todo = min(int(left[k]), width // n)
        while todo > 0 and not reached[rest]:
            m = min(many, todo)
            todo, many = todo - m, many * 2
            new = ~reached
            new[: n * m] = False
            new[n * m :] &= reached[: width + 1 - n * m]
            by[new] = len(parts)
            reached |= new
            parts.append((k, m))
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - rest).argmin()])
    while at:
        k, m = parts[by[at]]
        take[k] += m
        at -= m * int(lengths[k])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many of ``counts`` documents to take of each length, for a sum near ``budget``."""
    size = int((lengths * counts).sum())
    if budget <= 0 or size == 0:
        return np.zeros(len(lengths), np.int64)
    reserve = max(reserve, min(2 * int(lengths.max()), LARGEST))
    take = np.array([int(c) * max(0, budget - reserve) // size for c in counts], np.int64)  # whole numbers of any size
    take[lengths == 0] = 0
    rest = budget - int((lengths * take).sum())
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        if n == 0 or rest <= reserve:
            break
        more = min(int(counts[k] - take[k]), (rest - reserve) // n)
        take[k] += more
        rest -= more * n
    left = counts - take
    if rest > 2 * reserve:  # every length left is longer than what could be filled: one document, or none
        some = np.flatnonzero((left > 0) & (lengths > 0))
        if len(some):
            k = some[np.abs(lengths[some] - rest).argmin()]
            if abs(int(lengths[k]) - rest) < rest:
                take[k] += 1
        return take
    return take + nearest_subset(lengths, left, rest)


def source_targets(sizes: DataFrame, source: str = "source", most: int = MOST, weights: tuple = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a materialised table.

    Sources in code point order, null last, weigh ``weights`` in turn and share all words; targets stop
    at ``most`` times the source's size and what is above is shared again by weight until none is
    above. Sources are numbered by ranges and their counts, so they may be many; each round of sharing
    is one aggregate."""
    spark = sizes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(source).isNull(), F.col(source)]
    ranged = sizes.withColumn("_null", F.col(source).isNull()).repartitionByRange(parts, "_null", source)
    ranged = materialise(ranged.withColumn("_part", F.spark_partition_id()), "sources")
    each = Window.partitionBy("_part").orderBy(*order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = ranged.withColumn("_rank", F.row_number().over(each) - 1).join(F.broadcast(base), "_part")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_base") + F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    weighed = materialise(ranked.select(source, "source_size", turn.cast("long").alias("_w")), "source-weights")
    cap = most * F.col("source_size")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first().t
    share, full = 0.0, None
    while True:
        capped = F.lit(False) if full is None else F.col("_w") * F.lit(share) > cap
        now = weighed.agg(
            F.count(F.when(capped, 1)).alias("n"),
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~capped, F.col("_w"))), F.lit(0)).alias("w"),
        ).first()
        if now.n == full:
            break
        full = now.n
        if now.w == 0:
            break
        share = (total - now.held) / now.w
    return weighed.select(source, "source_size", F.least(F.col("_w") * F.lit(float(share)), cap.cast("double")).alias("target"))


def mix(docs: DataFrame, seed: int = 12, most: int = MOST, weights: tuple = (1, 2, 3), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    taken is the size times how often the row is taken, 0 to ``most``. Null and wordless texts have size 0.
    A null source is a source of its own. Repeated rows and ids are rows like others; null ids are kept.
    An empty table gives no rows; a table without words has targets of 0. Other columns are not
    read. The same rows give the same result, in whatever order and partitions they come.
    """
    spark = docs.sparkSession
    prepare(spark)
    seeded = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(source), F.xxhash64(text))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), seeded.alias("h"))
    sized = materialise(sized, "document-sizes")
    counts = materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "length-counts")
    sizes = materialise(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "source-sizes")
    targets = materialise(source_targets(sizes, "source", most, weights).withColumnRenamed("source", "of"), "source-targets")
    same = F.col("source").eqNullSafe(F.col("of"))

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = min(most, int(target // size)) if size else 0
        budget = 0 if passes == most else int(target - passes * size + 0.5)
        take = fit(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), budget)
        return pd.DataFrame({"source": rows["source"], "size": rows["size"], "source_size": size, "target": target, "passes": passes, "take": take, "n": rows["n"]})

    known = F.broadcast(targets) if small(targets) else targets
    joined = counts.join(known, same).select("source", "size", "n", "source_size", "target")
    planned = joined.groupBy("source").applyInPandas(plan, "source string, size long, source_size long, target double, passes int, take long, n long")
    planned = planned.withColumn("buckets", F.when((F.col("take") > 0) & (F.col("take") < F.col("n")), F.ceil(F.col("n") / RANKED)).otherwise(0).cast("int"))
    planned = materialise(planned.withColumnRenamed("source", "of").withColumnRenamed("size", "length"), "length-plan")

    here = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("length"))
    rows = sized.join(F.broadcast(planned) if small(planned) else planned, here).drop("of", "length")
    rows = rows.withColumn("bucket", F.when(F.col("buckets") > 0, F.pmod("h", "buckets")).otherwise(0).cast("int"))
    rows = materialise(rows, "planned-documents")
    # where a length is taken in part: buckets by their counts, and the one where the count ends by rank
    partly = rows.where("buckets > 0")
    filled = partly.groupBy("source", "size", "bucket").agg(F.count("*").alias("m"), F.first("take").alias("take"))
    upto = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    filled = filled.withColumn("room", F.col("take") - F.coalesce(F.sum("m").over(upto), F.lit(0)))
    filled = filled.select(F.col("source").alias("of"), F.col("size").alias("length"), F.col("bucket").alias("place"), F.when(F.col("room") >= F.col("m"), F.lit(-1)).otherwise(F.greatest("room", F.lit(0))).alias("room"))
    filled = materialise(filled, "bucket-rooms")
    found = F.broadcast(filled) if small(filled) else filled
    partly = partly.join(found, here & (F.col("bucket") == F.col("place")))
    some = Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id")
    ends = partly.where("room > 0").withColumn("extra", (F.row_number().over(some) <= F.col("room")).cast("int"))
    others = partly.where("room <= 0").withColumn("extra", (F.col("room") < 0).cast("int"))
    whole = rows.where("buckets = 0").withColumn("extra", (F.col("take") > 0).cast("int"))
    out = ["doc_id", "source", "size", "source_size", "target", ((F.col("passes") + F.col("extra")) * F.col("size")).alias("taken")]
    return whole.select(*out).unionByName(others.select(*out)).unionByName(ends.select(*out))


def op12_source_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
