"""Language ID, its CRF, and the quality classifier."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.llm import crf, language, quality

SCHEMA = "doc_id long, text string, lang string"


def test_forward_backward_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(2)
    trans = rng.normal(size=(3, 3))
    lengths = np.array([4, 1, 3])
    scores = rng.normal(size=(4, 3, 3))
    post, log_z, *_ = crf.forward_backward(scores, lengths, trans)
    _, _, expected, _ = crf.pair_counts(scores, lengths, trans)
    want_pairs = np.zeros((3, 3))
    best = crf.viterbi_batch(scores, lengths, trans)
    for b, n in enumerate(lengths):
        paths = list(itertools.product(range(3), repeat=n))
        value = np.array([sum(scores[t, b, p[t]] for t in range(n)) + sum(trans[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        w = np.exp(value - value.max())
        w /= w.sum()
        assert np.isclose(log_z[b], np.log(np.exp(value).sum()))
        for t in range(n):
            assert np.allclose(post[t, b], [sum(w[i] for i, p in enumerate(paths) if p[t] == k) for k in range(3)])
        for i, p in enumerate(paths):
            for t in range(n - 1):
                want_pairs[p[t], p[t + 1]] += w[i]
        assert tuple(best[:n, b]) == paths[value.argmax()]
        assert tuple(crf.viterbi(scores[:n, b], trans)) == paths[value.argmax()]
    assert np.allclose(expected, want_pairs)


def test_code_switched_words_are_labelled():
    a = ["kala malo tako " * 12, "malo kata tala " * 12]
    b = ["weng xing zheng " * 12, "zhong weng quong " * 12]
    model = language.LanguageModel.fit(a + b, ["aa", "aa", "bb", "bb"], sequences=200)
    labels = model.label_words("kala malo tako kata weng xing zheng quong, malo kala tako")
    assert [g for _, g in labels] == ["aa"] * 4 + ["bb"] * 4 + ["aa"] * 3


def test_language_edge_cases(spark):
    rows = [(i, t * 10, g) for i in range(40) for t, g in [("kala malo tako ", "aa") if i % 2 else ("weng xing zheng ", "bb")]]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "123 ... !!", None), (103, "KALA MALO", None), (104, "kala " * 20_000, "aa"), (105, "weng", None), (105, "weng", None), (None, "tako", "aa")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("_rank", F.lit(1))
    found = language.predict(docs, language.fit_from(docs))
    assert found.columns == ["doc_id", "text", "lang", "_rank", "lang_pred", "score"]
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert got[103].lang_pred == got[104].lang_pred == got[None].lang_pred == "aa" and got[105].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"clash"} and {r.doc_id for r in kept.collect()} == set(got) - {100, 101, 102}


def test_language_of_empty_and_unlabelled_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.predict(empty, language.fit_from(empty)).count() == 0
    bare = spark.createDataFrame([(1, "some text", None)], SCHEMA)
    r = language.predict(bare, language.fit_from(bare)).first()
    assert (r.lang_pred, r.score) == ("und", 0.0)


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = language.op1_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (p.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in p.doc_id]).all()
    held = p[p.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.95


def test_passages_do_not_see_their_neighbours():
    texts = ["", "abc def\n\nghi", None, "  \n ", "X!! Y!!", "a b" * 100, "é" * 500]
    x, counts, grams, sizes = quality.encode_passages(texts)
    at, edge = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sizes)])
    assert counts.sum() == len(x) == len(sizes) and (counts > 0).all() and len(grams) == edge[-1] and grams.max() < quality.GRAMS
    for i, t in enumerate(texts):
        own = quality.encode_passages([t])
        assert np.array_equal(own[0], x[at[i] : at[i + 1]])
        assert np.array_equal(own[2], grams[edge[at[i]] : edge[at[i + 1]]])


def test_scores_equal_a_plain_loop_and_gradients_finite_differences():
    rng = np.random.default_rng(4)
    model = quality.AttentionModel({k: rng.normal(0, 0.3, s) for k, s in quality.AttentionModel.SHAPES.items()})
    bags = quality.encode_passages(["one two three\nfour five", "", "Six!! six!! six!!\n\nseven\neight nine"])
    x, counts, grams, sizes = bags
    p, at, edge, want = model.weights, 0, np.concatenate([[0], np.cumsum(sizes)]), []
    for c in counts:
        hs, ss = [], []
        for k in range(at, at + c):
            own = grams[edge[k] : edge[k + 1]]
            h = np.tanh(x[k] @ p["w"] + (p["e"][own].mean(0) if len(own) else 0))
            hs.append(h)
            ss.append(float(p["a"] @ (np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"]))))))
        a = np.exp(ss) / np.exp(ss).sum()
        want.append(1 / (1 + np.exp(-(sum(w * h for w, h in zip(a, hs)) @ p["c"] + p["b"]))))
        at += c
    assert np.allclose(model.scores(*bags), want)
    x = x.astype(float)
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        s = model.scores(x, counts, grams, sizes)
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / w.sum()

    grad = model.gradient(x, counts, grams, sizes, y, w)
    for k, v in p.items():
        places = [(int(grams[j]), 3) for j in (0, 4, 7)] if k == "e" else [tuple(int(rng.integers(n)) for n in v.shape) for _ in range(5)]
        for i in places:
            old, eps = float(v[i]), 1e-5
            v[i] = old + eps
            up = loss()
            v[i] = old - eps
            down = loss()
            v[i] = old
            assert np.isclose((up - down) / (2 * eps), grad[k][i], atol=1e-7), (k, i)


def test_attention_gradient_learns_one_bad_passage():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for i in range(120):
        lines = ["the quick brown fox jumps over it" for _ in range(int(rng.integers(1, 5)))]
        if i % 2:
            lines[int(rng.integers(len(lines)))] = "BUY!! NOW!! BUY!! NOW!! BUY!!"
        bags.append("\n".join(lines))
        labels.append(float(i % 2 == 0))
    got = quality.encode_passages(bags)
    counts, y = got[1], np.array(labels)
    model = quality.AttentionModel.fit(*got, y, np.ones(len(y)), epochs=40)
    assert ((model.scores(*got) >= 0.5) == y).mean() > 0.97
    weights = model.attention(*got)
    at = np.concatenate([[0], np.cumsum(counts)])
    assert all(np.isclose(weights[a:b].sum(), 1) for a, b in zip(at[:-1], at[1:]))


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(i, ("fine words here\n" if i % 2 else "BAD!! ") * 8) for i in range(60)] + [(100, None), (101, ""), (102, "x" * 300_000), (None, "fine"), (103, "same"), (103, "same")], "doc_id long, text string").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(100, 1, 0), (1, None, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.fit_from(docs, labels))
    assert scored.columns == ["doc_id", "text", "score"]
    rows = scored.collect()
    assert len(rows) == 66 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 103}) == 1
    none = labels.where("false")
    assert {r.score for r in quality.score(docs, quality.fit_from(docs, none)).collect()} == {0.5}
    assert quality.score(docs.where("false"), quality.fit_from(docs, labels)).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {9}


def test_quality_held_out(spark, sf_dir):
    p = quality.op3_quality_classifier(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    p = p.merge(labels, on="doc_id")
    held = p[p.held_out]
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() >= 0.8
    assert (p.predicted == (p.score >= 0.3)).all()


@pytest.mark.parametrize("words", [[], ["a"], ["ab", "café", "x" * 60]])
def test_ngrams_cover_each_word(words):
    if words:
        ids, owners = language.ngram_ids(words)
        n = [len(w) + 2 for w in words]
        want = [sum(max(0, k - g + 1) for g in (2, 3, 4)) + k - 2 for k in n]
        assert np.bincount(owners, minlength=len(words)).tolist() == want and ids.max() < language.HASHES
