"""Language identification by a linear-chain CRF over the words of a text.

Every word is a position; its features are its lexicon languages and its hashed
character n-grams of 1 to 4 letters with word boundaries (so affixes are among
them). Training sequences splice stretches of labelled documents of different
languages, so the transitions learn how text switches. A text's words get
posteriors by forward-backward; the label with the largest mean posterior is the
document's language and that mean its score.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import kept, prepare, slices, smallest_hashes

WORD = re.compile(r"[^\W\d_]+")
HASHES = 1 << 15
#: Cells (words times texts) of one padded batch.
CELLS = 150_000
KNOWN_WORDS = 250_000


def ngram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of ``^word$``'s n-grams, and the word that each is of."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # letters up to the word's end
    ids, owners = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, 5):
        h[: len(points) - n + 1] = (h[: len(points) - n + 1] * np.uint64(1000003)) ^ points[n - 1 :]
        ok = left >= n
        if n == 1:
            ok &= (points != 94) & (points != 36)
        mixed = (h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        ids.append((mixed >> np.uint64(49)).astype(np.int64))
        owners.append(owner[ok])
    return np.concatenate(ids), np.concatenate(owners)


class LanguageModel:
    def __init__(self, labels: list[str], lexicon: dict[str, list[int]], weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.lexicon, self.weights, self.transitions = labels, lexicon, weights, transitions
        self._words: dict[str, int] = {}
        self._scores = np.zeros((1024, len(labels)), np.float32)

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], lexicon_size: int = 200, sequences: int = 1500, seed: int = 7) -> LanguageModel:
        labels = sorted(set(langs))
        docs = [(WORD.findall(t.lower()), labels.index(g)) for t, g in zip(texts, langs)]
        docs = [d for d in docs if d[0]]
        counts = [Counter() for _ in labels]
        for words, g in docs:
            counts[g].update(words)
        lexicon: dict[str, list[int]] = {}
        for g, c in enumerate(counts):
            for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]:
                lexicon.setdefault(w, []).append(g)
        rng = np.random.default_rng(seed)
        by = [[i for i, d in enumerate(docs) if d[1] == g] for g in range(len(labels))]
        present = [g for g in range(len(labels)) if by[g]]
        features, owners, golds = [], [], []
        model = cls(labels, lexicon, np.zeros((HASHES + len(labels), len(labels))), np.zeros((len(labels), len(labels))))
        for _ in range(sequences if present else 0):
            words, gold = [], []
            while len(words) < 40:
                g = present[rng.integers(len(present))]
                own = docs[by[g][rng.integers(len(by[g]))]][0]
                size = int(rng.integers(4, 30))
                at = int(rng.integers(0, max(1, len(own) - size)))
                words += own[at : at + size]
                gold += [g] * len(own[at : at + size])
            ids, own = model.features(words)
            features.append(ids), owners.append(own), golds.append(np.array(gold))
        if golds:
            model.weights, model.transitions = crf.train(features, owners, golds, HASHES + len(labels), len(labels), seed=seed)
        return model

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, owners = ngram_ids(words)
        found = [(HASHES + g, i) for i, w in enumerate(words) for g in self.lexicon.get(w, ())]
        if found:
            extra = np.array(found)
            ids, owners = np.concatenate([ids, extra[:, 0]]), np.concatenate([owners, extra[:, 1]])
        return ids, owners

    def learn(self, words: list[str]) -> None:
        """Score words not met before; what is known is only a memory of scores."""
        first = len(self._words)
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            ids, owners = self.features(some)
            scores = np.stack([np.bincount(owners, self.weights[ids, k], len(some)) for k in range(len(self.labels))], 1)
            need = first + len(some)
            if need > len(self._scores):
                self._scores = np.concatenate([self._scores, np.zeros((max(need, len(self._scores)), len(self.labels)), np.float32)])
            self._scores[first:need] = scores
            self._words.update(zip(some, range(first, need)))
            first = need

    def identify(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Numbers of known words for each text given as its words."""
        new = set()
        for words in texts:
            new.update(words)
        self.learn(sorted(new.difference(self._words)))
        get = self._words.__getitem__
        return [np.fromiter(map(get, w), np.int32, len(w)) for w in texts]

    def forget(self) -> None:
        if len(self._words) > KNOWN_WORDS:
            self._words.clear()

    def posteriors(self, ids: list[np.ndarray]) -> np.ndarray:
        """Mean label posteriors of each text of ``identify`` (no words: zeros)."""
        out = np.zeros((len(ids), len(self.labels)))
        order = sorted((i for i, w in enumerate(ids) if len(w)), key=lambda i: len(ids[i]))
        while order:
            longest = len(ids[order[-1]])
            many = max(1, CELLS // longest)
            # a padded batch holds texts of at least half the longest's words
            group = [i for i in order[-many:] if 2 * len(ids[i]) >= longest or longest < 64]
            order = order[: len(order) - len(group)]
            lengths = np.array([len(ids[i]) for i in group])
            padded = np.zeros((longest, len(group)), np.int64)
            for b, i in enumerate(group):
                padded[: lengths[b], b] = ids[i]
            post, *_, live = crf.forward_backward(self._scores[padded].astype(np.float64), lengths, self.transitions)
            out[group] = (post * live[:, :, None]).sum(0) / lengths[:, None]
        return out

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """The most probable label of each word of a code-switched text."""
        words = WORD.findall(text.lower())
        if not words:
            return []
        self.learn(sorted(set(words).difference(self._words)))
        scores = self._scores[[self._words[w] for w in words]].astype(np.float64)[:, None, :]
        post, *_ = crf.forward_backward(scores, np.array([len(words)]), self.transitions)
        return [(w, self.labels[k]) for w, k in zip(words, post[:, 0].argmax(1))]


def fit_from(docs: DataFrame, per_language: int = 250, languages: int = 64, letters: int = 50_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from at most ``per_language`` documents of each of the ``languages`` most frequent non-null languages,
    those with the smallest hashes among documents with crc32(doc_id) mod 4 <> 2; of several rows of
    one document and language the text with the smallest hash, and of a longer text ``letters`` characters
    from its middle. So what reaches the driver is bounded by these three numbers."""
    rows = docs.where((F.crc32(F.col(doc_id).cast("string")) % 4 != 2) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    often = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(languages).select("_lang")
    rows = rows.join(F.broadcast(often), "_lang", "left_semi")  # at most ``languages`` rows
    ids = smallest_hashes(rows.select("_id", "_lang").distinct(), "_lang", "_id", per_language).select("_id", "_lang").distinct()
    middle = F.expr(f"substring(_text, greatest(1, (char_length(_text) - {letters}) div 2 + 1), {letters})")
    some = rows.join(F.broadcast(ids), ["_id", "_lang"], "left_semi").select("_id", "_lang", F.struct(F.xxhash64("_text").alias("h"), middle.alias("t")).alias("one"))
    sample = some.groupBy("_id", "_lang").agg(F.min("one").alias("one")).orderBy("one.h", "one.t", "_lang").collect()
    return LanguageModel.fit([r.one.t for r in sample], [r._lang for r in sample])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row.

    Null texts and texts without a letter get ``und`` with score 0, as does any
    text when nothing was learned. Ties go to the label that sorts first. Rows
    are judged by text alone, so repeated rows agree. Columns called lang_pred or
    score are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast((model.labels, model.lexicon, model.weights, model.transitions))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = kept(key, lambda: LanguageModel(*sent.value))  # with its words' scores
        for series in texts:
            if not own.labels:
                yield pd.DataFrame({"lang_pred": ["und"] * len(series), "score": 0.0})
                continue
            own.forget()
            ids = []
            for some in slices(series):  # words as strings are short-lived
                words = [[] if t is None else WORD.findall(t.lower()) for t in some]
                ids += own.identify([w if any(map(str.isalpha, w)) else [] for w in words])
            post = own.posteriors(ids)
            best = post.argmax(1)
            yield pd.DataFrame({
                "lang_pred": [own.labels[k] if len(i) else "und" for k, i in zip(best, ids)],
                "score": np.minimum(post.max(1), 1.0),
            })

    judge = F.pandas_udf(run, "lang_pred string, score double")
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*others, judge(F.col(text)).alias("lang_pred"))
    return out.select(*others, "lang_pred.lang_pred", "lang_pred.score")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` without those of no language or whose language holds less than ``least``."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))  # docs may have columns of these names
    return predict(rows, fit_from(docs), "_text").where(f"lang_pred <> 'und' and score >= {least}").select("_row.*")


def op1_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, fit_from(docs))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score")
