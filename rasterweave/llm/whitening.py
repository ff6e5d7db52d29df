"""Embedding whitening by polarisation covariance.

Entries become whole numbers. Over all vectors the squares of every centred dimension, and of
every sum of two centred dimensions, are summed exactly; since
(a + b)^2 - a^2 - b^2 = 2ab, differences of these sums are all cross-covariances. The matrix
goes to ``eigh``, and rows are projected on its leading unit eigenvectors.

What reaches the driver is a number for each dimension and pair of dimensions, however many
rows there are. All tasks work on batches of rows and hand on one such set of sums.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Numbers of a batch that work on pairs of dimensions holds at a time.
CELLS = 4_000_000
SUMS = "dim int, i int, j int, n long, total decimal(38,0)"


def grid(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows that stay."""
    v = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = f"v is not null and size(v) > 0 and forall(v, c -> c is not null and c = c and abs({SCALE} * c) < {1 << 53}D)"
    return v.where(fine).select("vec_id", F.expr(f"transform(v, c -> cast(floor({SCALE} * c) as bigint) + {SHIFT})").alias("x"))


def by_dim(batch: pd.DataFrame):
    """(dim, rows of the batch, matrix) for each vector length in a batch."""
    sizes = batch["x"].map(len).to_numpy()
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, np.stack(batch["x"].iloc[rows].to_list()).astype(np.int64)


def safe(x: np.ndarray, terms: int) -> np.ndarray:
    """x for exact sums of ``terms`` squares of sums of two: Python's integers where 64 bits are too few."""
    most = int(np.abs(x).max(initial=0))
    return x if 4 * most * most * max(1, terms) < 1 << 62 else x.astype(object)


def first_sums(batches):
    """n and the sum of each dimension."""
    found: dict[int, list] = {}
    for batch in batches:
        for dim, _, x in by_dim(batch):
            own = found.setdefault(dim, [0, np.zeros(dim, object)])
            own[0] += len(x)
            own[1] += safe(x, len(x)).sum(0)
    for dim, (n, s) in found.items():
        yield pd.DataFrame({"dim": dim, "i": np.arange(dim), "j": -1, "n": n, "total": [Decimal(int(v)) for v in s]})


def square_sums(y: np.ndarray, i: int) -> np.ndarray:
    """Sums of y_i^2 and of (y_i + y_j)^2 for each j > i, exact."""
    pair = y[:, i:] + y[:, i : i + 1]
    pair[:, 0] = y[:, i]
    return (pair * pair).sum(0)


def second_sums(sent):
    """Exact sums of (n x_i - S_i)^2 (i = j) and of ((n x_i - S_i) + (n x_j - S_j))^2.

    With m the rounded mean and y = x - m, n x - S is n y - r for r = S - n m: a task's squares are
    summed over the small y and put together once, in whole numbers of any size."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in by_dim(batch):
                m, _ = rounded_mean(*sent.value[dim])
                own = found.setdefault(dim, [0, np.zeros(dim, object), [np.zeros(dim - i, object) for i in range(dim)]])
                for at in range(0, len(x), max(1, CELLS // dim)):
                    y = x[at : at + max(1, CELLS // dim)] - m
                    y = safe(y, len(y))
                    own[0] += len(y)
                    own[1] += y.sum(0)
                    for i in range(dim):
                        own[2][i] += square_sums(y, i)
        for dim, (rows, once, squares) in found.items():
            n, (_, r) = sent.value[dim][0], rounded_mean(*sent.value[dim])
            i, j = np.triu_indices(dim)
            q, apart = np.concatenate(squares), i != j
            shift, total = r[i] + r[j] * apart, once[i] + once[j] * apart
            q = n * n * q - 2 * n * shift * total + rows * shift * shift
            yield pd.DataFrame({"dim": dim, "i": i, "j": j, "n": 0, "total": [Decimal(int(v)) for v in q]})

    return run


def rounded_mean(n: int, sums: list) -> tuple[np.ndarray, np.ndarray]:
    """m, the mean rounded, and what S = sum x exceeds n m by, in integers of any size."""
    m = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(m, np.int64), np.array([s - n * k for s, k in zip(sums, m)], object)


def covariance(n: int, dim: int, sums: dict) -> np.ndarray:
    """From the sums of squares: 2 cov_ij n^3 = Q_ij - Q_ii - Q_jj, divided last."""
    v = np.zeros((dim, dim))
    for (i, j), q in sums.items():
        top = 2 * q if i == j else q - sums[i, i] - sums[j, j]
        v[i, j] = v[j, i] = top / (2 * n**3)  # whole numbers, so this rounds once
    return v


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit vectors as columns, shares of the trace), falling; those without variance are left out."""
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1], vectors[:, ::-1]
    real = e > len(e) * np.finfo(float).eps * max(e[0], 0.0)
    keep = np.flatnonzero(real)[:most]
    return e[keep], vectors[:, keep], e[keep] / max(np.trace(v), np.finfo(float).tiny)


def fit(x: DataFrame, most: int = 32) -> dict:
    """For each vector length its n, sums, eigenvalues, unit vectors and explained shares."""
    spark = x.sparkSession
    prepare(spark)
    sums = x.select("x").mapInPandas(first_sums, SUMS).groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    lists: dict[int, tuple[int, list]] = {}
    for row in sums.orderBy("dim", "i").collect():  # one row a dimension
        lists.setdefault(row.dim, (row.n, []))[1].append(int(row.total))
    sent = spark.sparkContext.broadcast(lists)
    squares = x.select("x").mapInPandas(second_sums(sent), SUMS).groupBy("dim", "i", "j").agg(F.sum("total").alias("total"))
    found: dict[int, dict] = {}
    for row in squares.collect():  # one row a pair of dimensions
        found.setdefault(row.dim, {})[row.i, row.j] = int(row.total)
    return {dim: (n, s, *components(covariance(n, dim, found[dim]), most)) for dim, (n, s) in lists.items()}


def project(sent):
    """(vec_id, dim, deviation, whitened) of each row."""

    def run(batches):
        for batch in batches:
            parts = []
            for dim, rows, x in by_dim(batch):
                n, s, e, vectors, _ = sent.value[dim]
                m, r = rounded_mean(n, s)
                y = x - m
                far = n * (int(np.abs(y).max(initial=0)) + 1)
                d = y * n - r.astype(np.int64) if far * far * dim < 1 << 62 else y.astype(object) * n - r  # n x - S
                white = (d / n).astype(float) @ vectors / np.sqrt(e)
                parts.append(pd.DataFrame({"vec_id": batch["vec_id"].iloc[rows].to_numpy(), "dim": dim, "deviation": [Decimal(int(q)) for q in (d * d).sum(1)], "whitened": list(white)}))
            if parts:
                yield pd.concat(parts).astype({"vec_id": "Int64"})

    return run


def cross_sums(batches):
    """For each length n and the sums of products of whitened components, whose means are 0."""
    found: dict[int, list] = {}
    for batch in batches:
        sizes = batch["dim"].to_numpy()
        for dim in np.unique(sizes).tolist():
            w = np.stack(batch["whitened"][sizes == dim].to_list())
            own = found.setdefault(dim, [0, np.zeros((w.shape[1], w.shape[1]))])
            own[0] += len(w)
            own[1] += w.T @ w
    for dim, (n, c) in found.items():
        i, j = np.divmod(np.arange(c.size), max(1, len(c)))
        yield pd.DataFrame({"dim": dim, "i": i, "j": j, "n": n, "c": c.ravel()})


def whiten(table: DataFrame, most: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), for each row
    that stays and each of its leading ``most`` components.

    Rows whose vector is null, empty, or holds null or non-finite entries, or one of 2^53 / 64 and more, go.
    Vectors of each length have their own fit list and components; a component without
    variance (equal vectors, fewer rows than dimensions) has no rows. Null and repeated ids are rows like others.
    Other columns are not read; an empty table gives no rows. deviation is a decimal(38,0).
    """
    spark = table.sparkSession
    prepare(spark)
    x = grid(table, vec_id, vector)
    fitted = fit(x, most)
    sent = spark.sparkContext.broadcast(fitted)
    rows = materialise(x.mapInPandas(project(sent), "vec_id long, dim int, deviation decimal(38,0), whitened array<double>"), "whitened")
    crossed = rows.where("size(whitened) > 0").mapInPandas(cross_sums, "dim int, i int, j int, n long, c double")
    crossed = crossed.groupBy("dim", "i", "j").agg((F.sum("c") / F.sum("n")).alias("c"))
    off = F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    errors = {r.dim: r.error for r in crossed.groupBy("dim").agg(F.max(off).alias("error")).collect()}  # one row a length
    facts = [(dim, n, explained.tolist(), errors.get(dim)) for dim, (n, _, _, _, explained) in fitted.items()]
    facts = spark.createDataFrame(facts, "dim int, n long, explained array<double>, identity_error double")
    out = rows.join(F.broadcast(facts), "dim")  # one row a length
    return out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c")).select(
        "vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error"
    )


def op13_embedding_whitening(spark, sf_dir):
    """deviation is null where it is beyond a long."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
