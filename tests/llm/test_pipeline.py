"""The pipeline's stages on their own inputs, against brute force."""

import math

import numpy as np
import pytest

import corpus_pipeline
from rasterweave.llm import jaccard, language, quality, queries
from rasterweave.llm.common import materialise

from test_pairs import components, shingles5
from test_tokens import check_packing


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    items = {r.item_id: shingles5(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = materialise(stage(spark, docs, sf_dir), "stage")
        if name == "best-fit packing":
            check_packing(list(before.items()), out.collect(), 1024, 2)
            continue
        assert out.columns == docs.columns
        after = {r.doc_id for r in out.collect()}
        assert after <= set(before)
        if name == "language ID":
            judged = language.predict(docs, language.fit_from(docs)).collect()
            assert after == {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= 0.4}
        elif name == "quality classifier":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            scored = quality.score(docs, quality.fit_from(docs, labels)).collect()
            assert after == {r.doc_id for r in scored if r.score >= 0.3}
        elif name == "n-gram Jaccard join":
            sets = {i: jaccard.shingles_of(t or "", 5) for i, t in before.items()}
            links = [(a, b) for a in sets for b in sets if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            groups = components(sets, links)
            assert after == {i for i, c in groups.items() if i == c}
        else:
            own = {i: shingles5(t) for i, t in before.items()}
            held = {i for i, s in own.items() if any(q and len(q & s) >= 0.8 * len(q) - 1e-9 for q in items.values())}
            assert after == set(before) - held
        docs = out


def placed(rows):
    """What is packed, without the numbers of sequences, which are free."""
    return sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows)


def test_run_equals_the_stages_in_turn(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "turn")
    want = docs.collect()
    assert len(want) > 0 and placed(rows.collect()) == placed(want)


def test_language_scores_equal_plain_forward_backward(spark, sf_dir):
    """Each text by itself in logarithms, one word after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    model = language.fit_from(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    odd = [(1000, None), (1001, ""), (1002, "12 34 !"), (1003, "the"), (1004, "der und the of " * 30)]
    texts = {r.doc_id: r.text for r in docs.collect()} | dict(odd)
    got = language.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()

    def sum_of(logs):
        top = max(logs)
        return top + math.log(sum(math.exp(x - top) for x in logs))

    trans, labels = model.transitions.tolist(), range(len(model.labels))
    for r in got:
        words = language.WORD.findall((texts[r.doc_id] or "").lower())[:400]
        whole = language.WORD.findall((texts[r.doc_id] or "").lower())
        if not any(map(str.isalpha, whole)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        if len(whole) > len(words):
            continue  # long ones take too long here
        score = []
        for w in words:
            ids, _ = model.features([w])
            score.append(model.weights[ids].sum(0).tolist())
        ahead, behind = [score[0]], [[0.0] * len(labels)]
        for s in score[1:]:
            ahead.append([s[k] + sum_of([ahead[-1][j] + trans[j][k] for j in labels]) for k in labels])
        for s in score[:0:-1]:
            behind.insert(0, [sum_of([trans[j][k] + s[k] + behind[0][k] for k in labels]) for j in labels])
        mean = [0.0] * len(labels)
        for a, b in zip(ahead, behind):
            z = sum_of([x + y for x, y in zip(a, b)])
            mean = [m + math.exp(x + y - z) / len(words) for m, x, y in zip(mean, a, b)]
        assert r.score == pytest.approx(max(mean), abs=1e-4) and mean[model.labels.index(r.lang_pred)] == pytest.approx(max(mean), abs=1e-4)


def test_quality_scores_equal_the_formula(spark, sf_dir):
    """Each document by itself: attention over its passages, one at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 80").collect()} | {1000: None, 1001: "", 1002: "x"}
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    p = {k: np.asarray(v, float) for k, v in model.weights.items()}
    for i, text in texts.items():
        x, counts, grams, sizes = quality.encode_passages([text])
        hidden, at = [], 0
        for row, n in zip(x, sizes):
            pre = row.astype(float) @ p["w"]
            if n:
                pre = pre + p["e"][grams[at : at + n]].mean(0)
                at += n
            hidden.append(np.tanh(pre))
        gates = np.array([(np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"] for h in hidden])
        share = np.exp(gates - gates.max()) / np.exp(gates - gates.max()).sum()
        z = sum(s * h for s, h in zip(share, hidden))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(z @ p["c"] + p["b"]))), abs=1e-6)


def tables(spark, tmp_path, name, rows, extra=""):
    folder = f"file://{tmp_path}/{name}"
    schema = "doc_id long, text string, lang string, source string, n_chars long" + extra
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six")] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, "none", [])).count() == 0


def test_run_on_odd_tables(spark, tmp_path, sf_dir):
    """Nulls in every column, repeated rows, empty texts, and extra columns whose names clash with the operators' own."""
    some = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 30 and length(text) < 3000").collect()]
    rows = [*some, *some[:5], (None, some[0][1], None, None, None), (None, None, None, None, None), (900, "", "en", None, 0), (901, None, "en", "s", None), (None, some[1][1], "xx", None, 3)]
    clash = ", score double, lang_pred string, token long, component_id long, kept boolean, piece int, length long, part int, u long, meta long, hub long"
    folder = tables(spark, tmp_path, "odd", [(*r, 0.5, "x", 1, 2, True, 3, 4, 5, 6, 7, 8) for r in rows], clash)
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, folder), "odd")
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert out.exceptAll(docs).count() == 0  # rows pass through as they are
        docs = out
    assert placed(corpus_pipeline.run(spark, folder).collect()) == placed(corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect())


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
