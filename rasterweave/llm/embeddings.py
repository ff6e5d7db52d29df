"""Embedding near-duplicates by an inverted file with product-quantised residuals.

Coarse centroids split the vectors into lists. A vector's residual to its list's centroid is coded
by the nearest codeword in each subspace. Every vector probes its nearest lists;
table lookups give asymmetric distances to the codes there, those within the
threshold plus the code's own error are reranked by exact cosine in
double precision, and only exact links count. A pair is found if either vector
probes the other's list. The codebooks are fitted on a
bounded sample; every vector is indexed and every vector is a query. How many lists are probed
is measured: some vectors are compared with the whole table first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, prepare, sized_join

#: Rows of a block: a list's members and its probing queries meet in blocks.
BLOCK = 2048
#: Share of planted partners at the threshold that the probes have to find.
PLANTED = 0.995


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=k)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """Index of the nearest centre; with n > 1 the n nearest, in order."""
    out = []
    for at in range(0, len(x), 4096):
        d = (centres**2).sum(1)[None] - 2 * x[at : at + 4096] @ centres.T
        if n == 1:
            out.append(d.argmin(1))
        else:
            part = np.argpartition(d, min(n, d.shape[1]) - 1, axis=1)[:, :n]
            out.append(np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n) if n > 1 else 0, np.int64)


class Index:
    """Coarse centroids and a codebook for each subspace of the residuals."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int = 16, words: int = 64) -> Index:
        centres = kmeans(x, lists)
        rest = x - centres[nearest(x, centres)]
        books = [kmeans(part, words, seed=5 + i) for i, part in enumerate(np.array_split(rest, min(subspaces, x.shape[1]), axis=1))]
        return cls(centres, books)

    def split(self, x):
        edges = np.cumsum([b.shape[1] for b in self.books])[:-1]
        return np.split(x, edges, axis=1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.stack([nearest(part, b) for part, b in zip(self.split(x - self.centres[own]), self.books)], 1).astype(np.uint8)

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[own] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)

    def distances(self, queries: np.ndarray, one_list: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances (queries, codes) by one table a subspace."""
        total = np.zeros((len(queries), len(codes)), np.float32)
        for j, part in enumerate(self.split(queries - self.centres[one_list])):
            b = self.books[j]
            table = (part**2).sum(1)[:, None] - 2 * part @ b.T + (b**2).sum(1)[None]
            total += table.astype(np.float32)[:, codes[:, j]]
        return total


def local_forest(q: np.ndarray, b: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the block's links (queries, members) join."""
    rows, cols = np.nonzero(linked)
    if not len(rows):
        return []
    names, own = np.unique(np.concatenate([q[rows], b[cols]]), return_inverse=True)
    u, v = own[: len(rows)], own[len(rows) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(names))
    return list(zip(names[far].tolist(), names[label[far]].tolist()))


def enough_probes(distinct: DataFrame, normal, sent, asked: np.ndarray, ids: np.ndarray, threshold: float, probes: int, recall: float) -> int:
    """The fewest probes, ``probes`` at least, that find the share ``recall`` of the
    links that the vectors ``asked`` have in the whole table, over all these links and in
    the mean over these vectors, and the share PLANTED of partners planted for them at just ``threshold``, so that
    there always is a figure and one for the links that are hardest to find."""
    lists = len(sent.value.centres)
    steps = [min(probes, lists)]
    while steps[-1] < lists:
        steps.append(min(lists, steps[-1] + max(1, steps[-1] // 3)))
    if len(steps) == 1:
        return steps[0]
    reached = planted_steps(asked, sent.value.centres, threshold, steps)
    first = int(np.argmax(reached >= min(PLANTED, reached[-1])))
    queries = distinct.sparkSession.sparkContext.broadcast((asked, ids))

    def step_of(d, of):
        """(rows, of): the first step whose probes reach list ``of``."""
        edge = np.partition(d, [k - 1 for k in steps], axis=1)[:, [k - 1 for k in steps]]
        return sum((d[:, of] > edge[:, [k]]).astype(np.int8) for k in range(len(steps) - 1))

    def reach(batches):
        centres, (q, qid) = sent.value.centres, queries.value
        own = nearest(q, centres)
        norms = (centres**2).sum(1)[None]
        away = np.concatenate([step_of(norms - 2 * q[a : a + 256] @ centres.T, np.arange(lists)) for a in range(0, len(q), 256)])
        for batch in batches:
            total = np.zeros((len(q), len(steps)), np.int64)
            for a in range(0, len(batch), BLOCK):
                part = batch.iloc[a : a + BLOCK]
                x, copies = normal(part["v"]), part["copies"].to_numpy()
                rows, cols = np.nonzero((x @ q.T >= threshold) & (part["id"].to_numpy()[:, None] != qid[None]))
                if not len(rows):
                    continue
                step = away[cols, nearest(x, centres)[rows]]
                far = np.unique(rows[step > 0])
                if len(far):
                    back = step_of(norms - 2 * x[far] @ centres.T, own)
                    late = step > 0
                    step[late] = np.minimum(step[late], back[np.searchsorted(far, rows[late]), cols[late]])
                np.add.at(total, (cols, step), copies[rows])
            at, step = np.nonzero(total)
            yield pd.DataFrame({"at": at, "step": step, "n": total[at, step]})

    links = np.zeros((len(asked), len(steps)))
    found = distinct.select("id", "copies", "v").mapInPandas(reach, "at int, step int, n long")
    for r in found.groupBy("at", "step").agg(F.sum("n").alias("n")).collect():  # at most asked x steps rows
        links[r["at"], r["step"]] = r["n"]
    links = links[links.sum(1) > 0]
    if not len(links):
        return steps[first]
    share = np.minimum(links.sum(0).cumsum() / links.sum(), (links.cumsum(1) / links.sum(1, keepdims=True)).mean(0))
    return steps[max(first, int(np.argmax(share >= min(recall, share[-1]))))]


def planted_steps(asked: np.ndarray, centres: np.ndarray, threshold: float, steps: list[int], seed: int = 29) -> np.ndarray:
    """For each number of probes the share of found pairs, of vectors and partners turned away from
    them in a random direction until their cosine is ``threshold``. Found is a pair if either probes the other's list."""
    turn = np.random.default_rng(seed).normal(size=asked.shape)
    turn -= (turn * asked).sum(1, keepdims=True) * asked
    norm = np.sqrt((turn**2).sum(1, keepdims=True))
    some = norm[:, 0] > 1e-9  # vectors of one dimension have no other direction
    if not some.any():
        return np.ones(len(steps))
    x = asked[some]
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * turn[some] / norm[some]
    ranks = []
    for a, b in ((x, y), (y, x)):  # how many lists are nearer to a than b's own
        own = nearest(b, centres)
        rank = []
        for at in range(0, len(a), 1024):
            d = (centres**2).sum(1)[None] - 2 * a[at : at + 1024] @ centres.T
            rank.append((d < np.take_along_axis(d, own[at : at + 1024, None], 1)).sum(1))
        ranks.append(np.concatenate(rank))
    best = np.minimum(*ranks)
    return np.array([(best < k).mean() for k in steps])


def as_bytes(rows) -> list[bytes]:
    """Vectors as floats of 4 bytes where these are exact, else of 8."""
    x = np.array(rows.tolist(), float)
    half = x.astype(np.float32)
    return [r.tobytes() for r in (half if (half == x).all() else x)]


def normal(rows, dim: int | None = None) -> np.ndarray:
    """Unit vectors in double precision, of lists or of what ``as_bytes`` made."""
    if dim is None:
        x = np.array(rows.tolist(), float)
    else:
        x = np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else float).astype(float) for b in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def near_vectors(table: DataFrame, threshold: float = 0.9, probes: int = 8, sample: int = 20_000, per_list: int = 128, vec_id: str = "vec_id", vector: str = "embedding", recall: float = 0.999, asked: int = 2000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``table``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
    their own component, as do rows of a null id (null component, kept null). Vectors of different
    lengths do not link; each length has its own index, so a table should have few. Equal vectors are searched once and link with each other. Repeated
    ids are distinct rows whose links add up. Links are those found by probing
    with exact cosine >= threshold; ``probes`` is the least number of lists probed, raised until
    the links of ``asked`` vectors are found to the share ``recall``. Codebooks are fitted on at most ``sample`` vectors of a length, those with
    the smallest hashes. Other columns are not read; an empty table gives no rows.
    """
    spark = table.sparkSession
    prepare(spark)
    t = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = "v is not null and size(v) > 0 and forall(v, x -> x is not null and x = x and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    # equal vectors have one key of 128 bits and stand for their smallest id
    key = ["dim", "k1", "k2"]
    good = t.where(fine).where("vec_id is not null").select("vec_id", F.size("v").alias("dim"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v").alias("k2"), "v")
    distinct = good.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    distinct = materialise(distinct, "distinct-vectors")
    good = good.select("vec_id", *key)
    found = None
    for row in distinct.groupBy("dim").count().orderBy("dim").collect():  # one row a length
        own = links_of(distinct.where(F.col("dim") == row["dim"]), row["dim"], row["count"], threshold, probes, sample, per_list, recall, asked)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], "u long, v long, n long")
    same = materialise(distinct.where("copies > 1").select(*key, "id"), "repeated-vectors")
    twins = sized_join(good, same, key, "inner").where("vec_id <> id").select(F.col("id").alias("u"), F.col("vec_id").alias("v")).distinct()
    comps = connected_components(found.where("u <> v").select("u", "v").unionByName(twins))
    links = found.where("u = v").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("found"))
    counted = distinct.join(links, "id", "left").select(*key, (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    counted = materialise(counted.where("n_links > 0"), "vector-counts")
    linked = sized_join(good, counted, key, "inner").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    out = t.select("vec_id").join(linked, "vec_id", "left").join(comps, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def links_of(distinct: DataFrame, dim: int, n: int, threshold: float, probes: int, sample: int, per_list: int, recall: float, asked: int) -> DataFrame:
    """(u, v, n) of distinct vectors of one length: edges that join what is linked (n = 0), and rows
    (id, id, n) whose n add up to the vectors that the id is linked with."""
    spark = distinct.sparkSession
    rows = distinct.select("v", "id", F.xxhash64("id").alias("h")).orderBy("h").limit(sample + asked).collect()
    picked, ids = normal(pd.Series([r[0] for r in rows])), np.array([r[1] for r in rows[:asked]])
    # vectors that ask do not train where there are enough, so that the recall is one of unseen vectors
    train = picked[asked:] if len(picked) >= 1.5 * asked else picked
    lists = int(min(4096, max(1, n // per_list)))
    sent = spark.sparkContext.broadcast(Index.fit(train, lists))
    probes = enough_probes(distinct, normal, sent, picked[:asked], ids, threshold, probes, recall)

    def index(batches):
        own_index = sent.value
        for batch in batches:
            x = normal(batch["v"])
            near = nearest(x, own_index.centres, min(probes, len(own_index.centres))).reshape(len(x), -1)
            codes = own_index.encode(x, near[:, 0])
            error = np.sqrt(((x - own_index.decode(near[:, 0], codes)) ** 2).sum(1))
            yield pd.DataFrame({"id": batch["id"], "copies": batch["copies"], "x": as_bytes(batch["v"]), "code": [c.tobytes() for c in codes], "error": error, "near": near.tolist()})

    coded = distinct.select("id", "copies", "v").mapInPandas(index, "id long, copies long, x binary, code binary, error double, near array<int>")
    coded = materialise(coded.withColumn("list", F.element_at("near", 1)), "coded-vectors")

    # lists are split into blocks of members and of queries by the id's hash, so
    # that a hot list is many groups of bounded size
    sizes = materialise(coded.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m")), "list-sizes")
    members = sized_join(coded, sizes, "list", "inner").withColumn("mb", F.pmod(F.xxhash64("id"), "m").cast("int"))
    members = members.select("list", "mb", "id", "copies", "x", "code", "error", "near", F.explode(F.expr("sequence(0, m - 1)")).alias("qb"))
    asking = coded.select("id", "copies", "x", F.col("list").alias("own"), F.explode("near").alias("list"))
    asking = sized_join(asking, sizes, "list", "inner").withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), "m").cast("int"))
    asking = asking.select("list", "qb", "id", "copies", "x", "own", F.explode(F.expr("sequence(0, m - 1)")).alias("mb"))
    left, right = members, asking.select(*[F.col(c).alias(f"q_{c}") for c in ("id", "copies", "x", "own", "list", "mb", "qb")])
    limit = 2 - 2 * threshold

    def meet(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        if not len(m) or not len(q):
            return empty
        own = sent.value
        codes = np.frombuffer(b"".join(m["code"]), np.uint8).reshape(len(m), -1)
        base, asks = normal(m["x"], dim), normal(q["q_x"], dim)
        mid, qid = m["id"].to_numpy(), q["q_id"].to_numpy()
        mc, qc = m["copies"].to_numpy(), q["q_copies"].to_numpy()
        # no link is farther from a code than its own error allows; float32 tables need a little more
        most = ((np.sqrt(limit) + m["error"].to_numpy()) ** 2 + 1e-4)[None]
        probed = np.zeros((len(m), len(own.centres)), bool)
        probed[np.arange(len(m))[:, None], np.stack(m["near"])] = True
        lists = q["q_own"].to_numpy()
        found_m, edges, out = np.zeros(len(m), np.int64), [], []
        for at in range(0, len(q), BLOCK):
            some = slice(at, at + BLOCK)
            near = own.distances(asks[some], int(m["list"].iloc[0]), codes) <= most
            # each pair once: the larger id's finding counts, the smaller's where the larger does not probe its list
            near &= (qid[some, None] > mid[None]) | ~probed[:, lists[some]].T
            rows, cols = np.nonzero(near)
            keep = np.zeros(len(rows), bool)
            for c in range(0, len(rows), 200_000):
                part = slice(c, c + 200_000)
                keep[part] = (asks[some][rows[part]] * base[cols[part]]).sum(1) >= threshold
            near[rows[~keep], cols[~keep]] = False
            n = near @ mc
            hit = n > 0
            out += zip(qid[some][hit].tolist(), n[hit].tolist())
            found_m += qc[some] @ near
            edges += local_forest(qid[some], mid, near)
        out += [(i, k) for i, k in zip(mid.tolist(), found_m.tolist()) if k]
        return pd.DataFrame([(u, v, 0) for u, v in edges] + [(i, i, k) for i, k in out], columns=["u", "v", "n"]).astype("int64") if edges or out else empty

    keys = ["list", "mb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"q_{k}" for k in keys])).applyInPandas(meet, "u long, v long, n long")
    return materialise(found, "vector-links")


def op9_embedding_near_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
