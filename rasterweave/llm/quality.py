"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages: its lines, long lines cut at every 64th word.
Each passage is encoded by the mean of learned embeddings of its hashed words and
pairs of neighbouring words, and by shares of adjacent character-class pairs and word repetition
figures, projected to the same hidden vector. Gated attention
(a tanh branch times a sigmoid branch) weighs the passages, the weighted mean of the
hidden vectors is scored, and only document labels are learned from.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, prepare, release, slices, smallest_hashes

PASSAGE_WORDS = 64
CLASSES = 16
HIDDEN, GATE = 32, 16
EXTRA = 8
#: Characters scored at a time; encoded passages are far larger than their text.
SCORED = 250_000
DIM = CLASSES * CLASSES + EXTRA
#: Places of the hashed words and word pairs.
GRAMS = 1 << 13


def _class_table() -> np.ndarray:
    t = np.full(256, 11, np.int64)
    t[:32] = 15
    for chars, k in ((b" \t\r\v\f", 0), (b"\n", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3), (b"0123456789", 4), (b".", 5), (b",", 6), (b"!", 7), (b"?", 8), (b"|", 9), (b"%$#&*@", 10), (b"\"'()[]", 13), (b":;-", 14)):
        t[list(chars)] = k
    t[128:] = 12
    return t


_TABLE = _class_table()
_MIX = np.random.default_rng(11).integers(1, 2**63, 64 * 256, dtype=np.uint64)


def encode_passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text, places of the words and
    word pairs of all passages in order, how many each passage has).

    Null, empty and blank texts have one passage of zeros without words.
    """
    raw = [b"" if t is None else t.encode() for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])  # after each text's newline
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    start = ~space
    start[1:] &= space[:-1]
    words = np.flatnonzero(start)
    doc = np.searchsorted(ends, words, side="right")
    line = np.cumsum(buf == 10)[words] if len(words) else words
    new_line = np.ones(len(words), bool)
    new_line[1:] = line[1:] != line[:-1]
    first = np.maximum.accumulate(np.where(new_line, np.arange(len(words)), 0)) if len(words) else words
    new_passage = new_line | ((np.arange(len(words)) - first) % PASSAGE_WORDS == 0)
    heads = np.flatnonzero(new_passage)
    owner = np.cumsum(new_passage) - 1  # passage of each word
    passages = len(heads)

    counts = np.bincount(doc[heads], minlength=len(texts)) if passages else np.zeros(len(texts), np.int64)
    features = np.zeros((passages, DIM), np.float32)
    grams, sizes = np.zeros(0, np.int64), np.zeros(passages, np.int64)
    if passages:
        begin = words[heads]
        stop = np.append(begin[1:], len(buf))
        body = np.minimum(stop, ends[doc[heads]] - 1)
        kinds = _TABLE[buf]
        pair = kinds[:-1] * CLASSES + kinds[1:]
        # a byte pair belongs to the passage it starts in, up to its text's end
        own = np.repeat(np.arange(passages), stop - begin)[:-1]
        inside = np.arange(begin[0], len(buf) - 1) < body[own]
        hist = np.bincount((own * (CLASSES * CLASSES) + pair[begin[0] :])[inside], minlength=passages * CLASSES * CLASSES)
        hist = hist.reshape(passages, -1) / np.maximum(1, body - begin)[:, None]
        features[:, : CLASSES * CLASSES] = np.sqrt(hist)

        size = np.where(~space, 1, 0)
        lengths = np.add.reduceat(size, words)
        at = np.arange(len(buf) - words[0], dtype=np.int64) - np.repeat(words - words[0], np.diff(np.append(words, len(buf))))
        mixed = _MIX[(at & 63) * 256 + buf[words[0] :]] * (2 * (at >> 6).astype(np.uint64) + np.uint64(1))
        mixed[space[words[0] :]] = 0
        hashes = np.add.reduceat(mixed, words - words[0])
        n = np.bincount(owner, minlength=passages)
        key = hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, where = np.unique(key, return_index=True)
        distinct = np.bincount(owner[where], minlength=passages)
        again = np.zeros(len(words), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        last = buf[words + lengths - 1]
        ended = np.zeros(len(words), bool)
        ended[1:] = (last[1:] == last[:-1]) & (owner[1:] == owner[:-1]) & (_TABLE[last[1:]] != 2)
        mean = np.bincount(owner, lengths, passages) / n
        spread = np.sqrt(np.maximum(0, np.bincount(owner, lengths.astype(float) ** 2, passages) / n - mean**2))
        upper = np.bincount(owner, _TABLE[buf[words]] == 3, passages) / n
        more = [distinct / n, np.bincount(owner, again, passages) / n, np.bincount(owner, ended, passages) / n, np.log(mean) / 3, np.log1p(spread) / 3, upper, np.log(n) / 4, np.ones(passages)]
        features[:, CLASSES * CLASSES :] = np.stack(more, 1)
        # each word, and its pair with the word before it in the passage
        pairs = hashes * np.uint64(3)
        pairs[1:] += hashes[:-1] * np.uint64(5)
        grams = (np.stack([hashes, pairs], 1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - GRAMS.bit_length() + 1)).astype(np.int64)
        inner = np.ones(grams.shape, bool)
        inner[heads, 1] = False
        grams, sizes = grams[inner], 2 * n - 1
    empty = counts == 0
    if empty.any():
        at = np.concatenate([[0], np.cumsum(counts)])[:-1][empty]
        features = np.insert(features, at, 0, axis=0)
        sizes = np.insert(sizes, at, 0)
        counts = counts + empty
    return features, counts, grams, sizes


class AttentionModel:
    """Weights, and scores of bags: sigmoid(c . sum_i a_i tanh(W x_i + mean of E) + b)."""

    SHAPES = {"w": (DIM, HIDDEN), "e": (GRAMS, HIDDEN), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "b": ()}

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    def _forward(self, x, counts, grams, sizes):
        p = self.weights
        pre, some = x @ p["w"], sizes > 0
        if some.any():
            pre[some] += np.add.reduceat(p["e"][grams], (np.cumsum(sizes) - sizes)[some]) / sizes[some, None]
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        own = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(pre)
        left, right = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = (left * right) @ p["a"]
        s = np.exp(s - np.maximum.reduceat(s, starts)[own])
        att = s / np.add.reduceat(s, starts)[own]
        z = np.add.reduceat(att[:, None] * h, starts)
        logit = z @ p["c"] + p["b"]
        return own, starts, h, left, right, att, z, 1 / (1 + np.exp(-logit))

    def scores(self, x, counts, grams, sizes) -> np.ndarray:
        """One score a bag, for what ``encode_passages`` gives."""
        return self._forward(x, counts, grams, sizes)[-1]

    def attention(self, x, counts, grams, sizes) -> np.ndarray:
        """The weight of each passage within its document."""
        return self._forward(x, counts, grams, sizes)[5]

    def gradient(self, x, counts, grams, sizes, labels, weights) -> dict[str, np.ndarray]:
        """Of the weighted mean logistic loss, by each weight."""
        p = self.weights
        own, _, h, left, right, att, z, y = self._forward(x, counts, grams, sizes)
        d = (y - labels) * weights / weights.sum()
        g = {"c": z.T @ d, "b": d.sum()}
        dz = d[:, None] * p["c"]
        along = (h * dz[own]).sum(1)
        ds = att * (along - np.bincount(own, att * along, len(counts))[own])
        dh = att[:, None] * dz[own]
        g["a"] = (left * right).T @ ds
        dl = ds[:, None] * p["a"] * right * (1 - left**2)
        dr = ds[:, None] * p["a"] * left * right * (1 - right)
        g["v"], g["u"] = h.T @ dl, h.T @ dr
        dh += dl @ p["v"].T + dr @ p["u"].T
        dh *= 1 - h**2
        g["w"] = x.T @ dh
        each = np.repeat(dh / np.maximum(1, sizes)[:, None], sizes, axis=0)
        order = np.argsort(grams, kind="stable")
        places, first = np.unique(grams[order], return_index=True)
        g["e"] = np.zeros_like(p["e"])
        if len(places):
            g["e"][places] = np.add.reduceat(each[order], first)
        return g

    @classmethod
    def fit(cls, x: np.ndarray, counts: np.ndarray, grams: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, l2: float = 1e-4, seed: int = 5) -> AttentionModel:
        """Weighted logistic loss, Adam over documents in random order."""
        rng = np.random.default_rng(seed)
        model = cls({k: rng.normal(0, 0.1 if k == "e" else 1 / np.sqrt(max(1, s[0] if s else 1)), s) if s else np.zeros(()) for k, s in cls.SHAPES.items()})
        p = model.weights
        m = {k: np.zeros_like(v) for k, v in p.items()}
        q = {k: np.zeros_like(v) for k, v in p.items()}
        starts = np.concatenate([[0], np.cumsum(counts)])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(counts))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                bx = np.concatenate([x[starts[i] : starts[i + 1]] for i in pick]).astype(np.float64)
                bg = np.concatenate([grams[edges[starts[i]] : edges[starts[i + 1]]] for i in pick])
                bs = np.concatenate([sizes[starts[i] : starts[i + 1]] for i in pick])
                g = model.gradient(bx, counts[pick], bg, bs, labels[pick], weights[pick])
                step += 1
                for k in p:
                    grad = g[k] + l2 * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    q[k] = 0.999 * q[k] + 0.001 * grad**2
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)
        return model


def fit_from(docs: DataFrame, labels: DataFrame, per_label: int = 1500, passages: int = 200, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> AttentionModel | None:
    """Learn from at most ``per_label`` documents of each label with
    crc32(doc_id) mod 5 <> 0, weighted back to the labels' shares; None without any.

    Labels other than 0 and 1 are left out; of several for one document the
    largest counts, and of several rows of one document the text with the smallest hash. At most
    ``passages`` passages of a document, evenly spaced, are learned from, so what reaches the driver is
    bounded by these two numbers. Passages are encoded on the executors.
    """
    spark = docs.sparkSession
    prepare(spark)
    marks = labels.where((F.crc32(F.col(doc_id).cast("string")) % 5 != 0) & F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.max(label).alias("_y"))
    totals = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    marks = smallest_hashes(marks.select(F.col(doc_id).alias("_id"), "_y"), "_y", "_id", per_label)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(marks), "_id")
    rows = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("one"), F.max("_y").alias("_y")).select("_id", "_y", "one._text")

    def encode(batches):
        release()
        for batch in batches:
            for i, y, t in zip(batch["_id"], batch["_y"], batch["_text"]):
                x, counts, grams, sizes = encode_passages([t])
                if len(x) > passages:
                    keep = np.unique(np.linspace(0, len(x) - 1, passages).astype(int))
                    grams = np.concatenate([g for k, g in enumerate(np.split(grams, np.cumsum(sizes)[:-1])) if k in set(keep.tolist())])
                    x, sizes = x[keep], sizes[keep]
                yield pd.DataFrame({"id": [i], "y": [y], "x": [x.astype(np.float16).tobytes()], "grams": [grams.astype(np.uint16).tobytes()], "sizes": [sizes.astype(np.uint16).tobytes()]})

    got = rows.mapInPandas(encode, "id long, y int, x binary, grams binary, sizes binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values("id", kind="stable")
    bags = [np.frombuffer(b, np.float16).reshape(-1, DIM) for b in got["x"]]
    grams, sizes = (np.frombuffer(b"".join(got[c]), np.uint16).astype(np.int64) for c in ("grams", "sizes"))
    y = got["y"].to_numpy()
    share = {k: totals[k] / max(1, (y == k).sum()) for k in totals}
    w = np.array([share[k] for k in y], float)
    return AttentionModel.fit(np.concatenate(bags), np.array([len(b) for b in bags]), grams, sizes, y.astype(float), w / w.mean())


def score(docs: DataFrame, model: AttentionModel | None, text: str = "text") -> DataFrame:
    """Add score, 0 to 1, to every row, from its whole text alone.

    Null, empty and blank texts get the model's score of a bag with one passage of
    zeros; without a model every score is 0.5. A column called score is replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(model.weights if model else None)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = kept(key, lambda: AttentionModel(sent.value) if sent.value is not None else None)
        for series in texts:
            if own is None:
                yield pd.Series(np.full(len(series), 0.5))
            else:
                yield pd.Series(np.concatenate([own.scores(*encode_passages(some)) for some in slices(series, SCORED)] or [np.zeros(0)]))

    others = [c for c in docs.columns if c != "score"]
    return docs.select(*others, F.pandas_udf(run, "double")(F.col(text)).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without those scored below ``least``."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))  # docs may have a column score
    return score(rows, fit_from(docs, labels), "_text").where(F.col("score") >= least).select("_row.*")


def op3_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fit_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )
