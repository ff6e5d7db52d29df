"""Best-fit packing by patterns fitted with non-negative least squares.

Pieces are counted by length; a pattern is a set of two or three lengths (or one
full length) that fills a sequence exactly. Repeat counts x >= 0 minimise
|A x - histogram|^2, are rounded without using more pieces than there are, and
what remains is packed best-fit decreasing. All of this works on the histogram
of at most ``capacity`` numbers. Pieces then find their slots by their rank
within their length.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare, sized_join
from .tokens import encoder as text_encoder


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All triples a >= b >= c >= 0 of present lengths with a + b + c = capacity."""
    here = np.zeros(capacity + 1, bool)
    here[lengths] = True
    here[0] = True
    a, b = np.meshgrid(np.arange(capacity + 1), np.arange(capacity + 1), indexing="ij")
    c = capacity - a - b
    ok = (a >= b) & (b >= c) & (c >= 0) & here[a] & here[b] & here[np.clip(c, 0, capacity)]
    return np.stack([a[ok], b[ok], c[ok]], 1)


def fit_repeats(p: np.ndarray, counts: np.ndarray, steps: int = 600) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient."""
    n = len(counts)
    used = p > 0

    def forward(x):
        return np.bincount(p.ravel(), np.repeat(x, 3), n) * (np.arange(n) > 0)

    scale = max(1.0, float(counts.max()))
    c = counts / scale
    # power iteration for the step length
    v = np.ones(len(p))
    for _ in range(30):
        r = forward(v)
        v = (r[p] * used).sum(1)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(p))
    t = 1.0
    for _ in range(steps):
        g = ((forward(y) - c)[p] * used).sum(1)
        new = np.maximum(0, y - g / (norm * 1.02))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * scale


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset): pieces of a
    length, numbered from 0, in runs that go to as many sequences in a row."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    bins: list[tuple[list[int], int]] = []
    if left[capacity]:
        bins.append(([capacity], int(left[capacity])))
        left[capacity] = 0
    present = np.flatnonzero(left)
    if len(present):
        p = patterns(present, capacity)
        if len(p):
            x = fit_repeats(p, left.astype(float))
            for k in np.argsort(-x, kind="stable"):
                want = int(x[k] + 0.5)
                if want == 0:
                    break
                kinds, many = np.unique(p[k][p[k] > 0], return_counts=True)
                r = min(want, int((left[kinds] // many).min()))
                if r > 0:
                    left[kinds] -= r * many
                    bins.append((p[k][p[k] > 0].tolist(), r))
    bins += _best_fit(left, capacity)
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, repeats in bins:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], repeats, sequence, offset))
            used[n] += repeats
            offset += n
        sequence += repeats
    return np.array(rows, np.int64).reshape(-1, 5)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on counts: equal bins are filled together."""
    open_: dict[int, dict[tuple, int]] = {}  # free room -> contents -> bins
    for n in np.flatnonzero(left)[::-1]:
        n, todo = int(n), int(left[n])
        room = n
        while todo:
            room = next((r for r in range(room, capacity) if open_.get(r)), None)
            if room is None:
                # new bins take as many of this length as fit
                each = capacity // n
                full, rest = divmod(todo, each)
                for number, k in ((full, each), (1 if rest else 0, rest)):
                    if number:
                        level = open_.setdefault(capacity - n * k, {})
                        level[(n,) * k] = level.get((n,) * k, 0) + number
                break
            contents, number = next(iter(open_[room].items()))
            # a bin that took a piece has the least room, so it takes the next ones too
            each = min(room // n, todo)
            take = min(number, todo // each)
            if take == number:
                del open_[room][contents]
            else:
                open_[room][contents] = number - take
            level = open_.setdefault(room - n * each, {})
            filled = contents + (n,) * each
            level[filled] = level.get(filled, 0) + take
            todo -= take * each
    return [(list(c), k) for level in open_.values() for c, k in level.items()]


def cut(docs: DataFrame, capacity: int, end_id: int, tokenizer: str | None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, local): tokenised pieces;
    local numbers the pieces of a length within a partition."""

    def pieces(batches):
        import pandas as pd
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        encoder = text_encoder(tokenizer)
        for batch in batches:
            own = batch["doc_id"].tolist()
            for at, ids, sizes in encoder.batches(batch["text"], end_id):
                rows, begin, raw = [], 0, memoryview(ids.tobytes())
                for doc_id, n in zip(own[at : at + len(sizes)], sizes.tolist()):
                    edge, k, done = n % capacity or capacity, 0, 0
                    while done < n:
                        rows.append((doc_id, k, done, edge - done, zlib.crc32(raw[4 * (begin + done) : 4 * (begin + edge)]), part, seen[edge - done]))
                        seen[edge - done] += 1
                        done, edge, k = edge, edge + capacity, k + 1
                    begin += n
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return docs.mapInPandas(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long")


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are the end id alone. A document over ``capacity`` is
    cut into pieces of ``capacity``, its first piece taking the remainder.
    Repeated rows and ids are packed as often as they occur; null ids stay null;
    other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = materialise(cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), capacity, end_id, tokenizer), "pieces")
    by_part = rows.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(by_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"), "count"), "length-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in bases.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most capacity rows
        counts[r.length] = r.n
    slots = spark.sparkContext.broadcast(_lookup(plan(counts, capacity)))
    bases = bases.select("part", "length", "base")
    ranked = sized_join(rows, bases, ["part", "length"], "inner")

    def place(batches):
        runs, first = slots.value
        for batch in batches:
            rank = batch["base"].to_numpy() + batch["local"].to_numpy()
            # runs are sorted by length and rank: one number orders both
            at = np.searchsorted(first, batch["length"].to_numpy() * (1 << 50) + rank, side="right") - 1
            batch["sequence_id"] = runs[at, 3] + rank - runs[at, 1]
            batch["offset"] = runs[at, 4]
            yield batch[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _lookup(runs: np.ndarray):
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    return runs, runs[:, 0] * (1 << 50) + runs[:, 1]


def op10_best_fit_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
