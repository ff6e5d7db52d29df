"""Source mixing and whitening against brute force."""

import itertools
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.llm import mixing, whitening

SPACES = " \t\n\x0b\f\r"


def size_of(text):
    for c in SPACES[1:]:
        text = (text or "").replace(c, " ")
    return sum(1 for w in text.split(" ") if w)


def targets_of(sizes):
    """source -> target, in exact arithmetic."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        share = Fraction(total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > 3 * sizes[s]]
        if not over:
            return capped | {s: weight[s] * share for s in free}
        capped |= {s: Fraction(3 * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", range(40))
def test_nearest_subset_equals_brute_force(seed):
    rng = random.Random(seed)
    lengths = np.array(rng.sample(range(0, 40), rng.randint(1, 5)))
    left = np.array([rng.randint(0, 3) for _ in lengths])
    rest = rng.randint(0, 120)
    take = mixing.nearest_subset(lengths, left, rest)
    assert (take >= 0).all() and (take <= left).all()
    sums = {int(np.dot(k, lengths)) for k in itertools.product(*[range(n + 1) for n in left])}
    assert int((take * lengths).sum()) == min(sums, key=lambda s: (abs(s - rest), s))


@pytest.mark.parametrize("reserve", [10, 1000, 1 << 16])
def test_fit_comes_near_the_budget(reserve):
    rng = np.random.default_rng(reserve)
    for _ in range(50):
        lengths = rng.permutation(np.arange(0, 3000))[: rng.integers(1, 300)]
        counts = rng.integers(1, 50, len(lengths))
        size = int((lengths * counts).sum())
        for budget in (0, 1, size // 3, size - 1, size):
            take = mixing.fit(lengths, counts, budget, reserve)
            assert (take >= 0).all() and (take <= counts).all()
            # some order of documents passes the budget in steps of the longest at most
            assert abs(int((take * lengths).sum()) - budget) <= (lengths.max() / 2 if len(lengths) < 50 or budget in (1, size - 1) else 1)


def documents():
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "B", "ä", "\U0001f600", "￿", None, ""])
        n = 7 if i % 2 else rng.choice([0, 1, 3, 50, 400])
        rows.append((i, rng.choice([" ", "\n", "\x0b "]).join(["w x"] * n), source))
    rows += [(5, None, None), (None, "one two", "a"), (None, None, "empty"), (9, "x " * 30_000, "tiny"), (9, "x", "tiny")] + rows[:20]
    return rows


def test_mix_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 50)  # many buckets
    rows = documents()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, bucket int")
    got = mixing.mix(df.repartition(3)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size_of(text)
    targets, taken = targets_of(sizes), defaultdict(int)
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(i), str(s), size_of(t)) for i, t, s in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(targets[r.source]))
        assert 0 <= r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1 or source == "tiny", source
    again = mixing.mix(df.orderBy(F.desc("doc_id")).coalesce(2)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(again, key=key)


def test_mix_of_little(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2
    one = mixing.mix(spark.createDataFrame([(1, "a b", "x")], schema)).first()
    assert (one.target, one.taken) == (2.0, 2)


def test_query_on_documents(spark, sf_dir):
    got = mixing.op12_source_mixing(spark, sf_dir)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert sum(r.taken for r in rows) == pytest.approx(sum(r.size for r in rows), rel=0.01)


def whitened_by_hand(vectors):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    d = n * x - s
    v = np.array([[float(Fraction(int((d[:, i] * d[:, j]).sum()), n**3)) for j in range(x.shape[1])] for i in range(x.shape[1])])
    e, q = np.linalg.eigh(v)
    return n, (d * d).sum(1), (d / n).astype(float) @ q[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), e[::-1] / np.trace(v)


def check_whitening(rows, vectors, most=32):
    """rows: of one vector length; vectors: vec_id -> vector."""
    ids = list(vectors)
    n, deviation, white, explained = whitened_by_hand([vectors[i] for i in ids])
    k = min(most, white.shape[1])
    assert len(rows) == len(ids) * k
    got = {(r.vec_id, r.component): r for r in rows}
    for c in range(1, k + 1):
        column = np.array([got[i, c].whitened for i in ids])
        sign = np.sign((column * white[:, c - 1]).sum())
        assert np.allclose(sign * column, white[:, c - 1], rtol=1e-7, atol=1e-9)
        for i, dev in zip(ids, deviation):
            r = got[i, c]
            assert r.n == n and int(r.deviation) == dev
            assert r.explained == pytest.approx(explained[c - 1], rel=1e-9) and r.identity_error < 1e-9


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    good = {i: (rng.normal(size=5) * [1, 2, 3, 0.5, 8] + 3).astype(np.float32).tolist() for i in range(200)}
    good |= {1000 + i: (rng.normal(size=3) * 1e6).astype(np.float32).tolist() for i in range(50)}
    bad = [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [float("nan")] * 5), (304, [float("inf")] * 5), (305, [3e38] * 5)]
    rows = [(i, v, "x") for i, v in [*good.items(), *bad]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim string").repartition(4)
    got = whitening.whiten(df).collect()
    check_whitening([r for r in got if r.vec_id < 300], {i: v for i, v in good.items() if i < 300})
    check_whitening([r for r in got if r.vec_id >= 1000], {i: v for i, v in good.items() if i >= 1000})
    assert not {r.vec_id for r in got} & {b[0] for b in bad}


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # no variance
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 5.0]), (None, [1.0, 5.0]), (1, [2.0, 5.0])], schema)).orderBy("whitened").collect()
    assert [r.component for r in flat] == [1, 1, 1] and sorted(str(r.vec_id) for r in flat) == ["1", "1", "None"]
    assert [abs(r.whitened) for r in flat] == pytest.approx([1.5**0.5, 0, 1.5**0.5]) and flat[0].explained == 1.0


def test_whitening_query(spark, sf_dir):
    rows = whitening.op13_embedding_whitening(spark, sf_dir)
    assert dict(rows.dtypes)["deviation"] == "bigint" and dict(rows.dtypes)["component"] == "int"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    check_whitening(rows.collect(), vectors)
