"""Near-duplicate joins, decontamination and embeddings against brute force."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.llm import common, decontaminate, embeddings, jaccard


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_connected_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(25)] + [(5, 5), (2000, 2000)]
    df = spark.createDataFrame(links + [(None, 3)], "u long, v long")
    got = {r.node: r.component for r in common.connected_components(df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == components(nodes, [p for p in links if p[0] != p[1]])
    assert common.connected_components(df.where("false")).count() == 0


def family():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    docs = []
    for _ in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(120)] = rng.choice(words)
        docs.append(" ".join(w))
    docs += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) + " " + " ".join(base[:25]) for _ in range(40)]
    return docs + docs[:20] + [None, "", " \n ", "One two", "one\tTWO", "a", "b", "x y z " * 4000, "x y z " * 4001]


@pytest.mark.parametrize(("few", "block", "split", "k", "percent"), [(32, 256, 10_000, 4, 85), (2, 16, 20, 5, 80)])
def test_jaccard_equals_brute_force(spark, monkeypatch, few, block, split, k, percent):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SPLIT", split)
    docs = family()
    df = spark.createDataFrame([(7 * i % 1009, t) for i, t in enumerate(docs)], "doc_id long, text string").withColumn("token", F.lit(1)).withColumn("u", F.lit("x"))
    sets = {7 * i % 1009: jaccard.shingles_of(t or "", k) for i, t in enumerate(docs)}
    links = [(a, b) for a in sets for b in sets if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = jaccard.near_duplicates(df, k, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert len(got) == len(docs)


def test_jaccard_of_a_large_cluster(spark):
    """5,000 near copies in a few families around the threshold, exact by brute force on NumPy rows."""
    rng = np.random.default_rng(17)
    base = [f"w{i}" for i in rng.integers(0, 5000, 60)]
    docs, change = [], rng.integers(0, 8, 5000)
    for i in range(5000):
        w = list(base)
        for at in rng.integers(0, 60, change[i]):
            w[at] = f"v{rng.integers(0, 40)}"
        docs.append(" ".join(w))
    sets = [jaccard.shingles_of(t, 4) for t in docs]
    names = {g: k for k, g in enumerate(set().union(*sets))}
    many = np.zeros((5000, len(names)), np.float32)
    for i, own in enumerate(sets):
        many[i, [names[g] for g in own]] = 1
    n, up = many.sum(1), list(range(5000))
    links = []
    for at in range(0, 5000, 500):
        both = many[at : at + 500] @ many.T
        u, v = np.nonzero(100 * both >= 85 * (n[at : at + 500, None] + n[None] - both))
        links += [(a + at, b) for a, b in zip(u.tolist(), v.tolist()) if b < a + at]
    want = components(up, links)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == want


def test_jaccard_of_repeated_ids(spark):
    """A document links when any of its rows' texts does."""
    one, two = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, one), (1, two), (2, one), (3, two + " x y"), (3, two), (4, "k l m n o"), (5, None), (5, "k l m n o")]
    got = sorted(map(tuple, jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 5, 1), (1, 5, 1), (2, 5, 1), (3, 5, 1), (3, 7, 1), (4, 2, 4), (5, 0, 4), (5, 2, 4)]


def test_jaccard_edge_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A B C D E"), (3, None)]
    got = sorted(map(tuple, jaccard.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)], key=str)
    kept = jaccard.keep_one(spark.createDataFrame(rows, schema))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "None"]


def test_prefix_choice_is_complete():
    """Any two sets over the threshold share the smaller l of their prefixes."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.arange(n)
        y = np.unique(np.concatenate([x[rng.random(n) > 0.1], rng.integers(100, 140, int(rng.integers(0, 4)))]))
        if not len(y) or 100 * len(np.intersect1d(x, y)) < 85 * len(np.union1d(x, y)):
            continue
        order = rng.permutation(140)
        pre = []
        for s in (x, y):
            s = s[np.argsort(order[s])]
            size, ell = jaccard.choose(rng.integers(0, 50, len(s)), len(s), -(-85 * len(s) // 100))
            pre.append((set(s[:size].tolist()), ell))
        assert len(pre[0][0] & pre[1][0]) >= min(pre[0][1], pre[1][1])


def test_index_prefixes_are_complete():
    """Two sets over the threshold share the smaller l within the smaller one's index prefix and the other's prefix."""
    rng = np.random.default_rng(8)
    for _ in range(600):
        x = np.arange(int(rng.integers(1, 60)))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.08], rng.integers(100, 140, int(rng.integers(0, 5)))]))
        if not len(y) or 100 * len(np.intersect1d(x, y)) < 85 * len(np.union1d(x, y)):
            continue
        order, found = rng.permutation(140), []
        for s in (x, y):
            s, n = s[np.argsort(order[s])], len(s)
            size, ell = jaccard.choose(rng.integers(0, 50, n), n, -(-85 * n // 100))
            found.append((n, s[:size], s[: n - -(-170 * n // 185) + ell], ell))
        (_, _, own, a), (_, pre, _, b) = sorted(found, key=lambda f: f[0])
        assert len(np.intersect1d(own, pre)) >= min(a, b)


def written_rows(monkeypatch, *names):
    """Rows of the tables of these names, as the join writes them."""
    rows, before = {}, jaccard.materialise

    def count(df, name):
        out = before(df, name)
        if name in names:
            rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "materialise", count)
    return rows


def test_pages_of_a_template_do_not_meet(spark, monkeypatch):
    """22 words in common and 3 of each page's own: Jaccard 0.76 for all pairs, so no link, and what meets does not grow with the square."""
    rows = written_rows(monkeypatch, "block-members", "block-candidates", "prefixes")
    common = " ".join(f"c{i}" for i in range(22))
    for m in (700, 1400):
        docs = [(i, f"{common} a{i} b{i} c{i}") for i in range(m)]
        got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
        assert got.where("doc_id <> component_id").count() == 0
        assert rows["block-members"] == rows["block-candidates"] == 0 and rows["prefixes"] == 0


def test_more_frequent_shingles_than_are_held(spark, monkeypatch):
    """Beyond the bound the most frequent ones are held, not none."""
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    scan = spark.createDataFrame([(1, i, n) for i, n in enumerate([20_000, 20_000, 20_100, 20_050, 20_001, 7, 3])], "kind int, a long, b long")
    keys, counts = jaccard.frequent(scan)
    assert 1 <= len(keys) <= 5 and (counts >= 20_000).all() and (np.sort(keys) == keys).all()
    monkeypatch.setattr(jaccard, "FREQUENT", 6)
    assert sorted(jaccard.frequent(scan)[1].tolist())[0] in (3, 7) and len(jaccard.frequent(scan)[0]) >= 5
    assert len(jaccard.frequent(scan.where("false"))[0]) == 0


def shingles5(text):
    import re

    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 6, 12, 40, 90])))) for i in range(25)] + [(90, None), (91, ""), (92, "!!")]
    docs = []
    for d in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            w = items[rng.randrange(25)][1].split()
            w = w[: max(1, int(len(w) * rng.uniform(0.7, 1)))]
            body[5:5] = [x.upper() + "," for x in w]
        docs.append((d, " ".join(body)))
    docs += [(200, None), (201, ""), (202, "t1"), (0, docs[0][1]), (None, items[0][1])]
    want = {}
    for d, t in docs:
        for i, q in items:
            s = shingles5(q)
            both = len(s & shingles5(t))
            if d is not None and s and both >= 0.8 * len(s) - 1e-9:
                want[d, i] = (len(s), both)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(0)).withColumn("item_id", F.lit(0))
    got = decontaminate.contained_items(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in got} == want and len(got) == len(want)
    kept = decontaminate.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_of_empty_tables(spark):
    schema, items = "doc_id long, text string", "item_id long, text string"
    some = spark.createDataFrame([(1, "a b c d e f")], schema)
    assert decontaminate.contained_items(some, spark.createDataFrame([], items)).count() == 0
    assert decontaminate.contained_items(some.where("false"), spark.createDataFrame([(1, "a b")], items)).count() == 0


def test_decontamination_equals_sql_without_python(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    df = decontaminate.op8_benchmark_decontamination(spark, sf_dir)
    columns = "doc_id, item_id, n_item, n_shared, containment"
    assert sorted(map(tuple, df.selectExpr(*columns.split(", ")).collect())) == sorted(con.sql(f"select {columns} from ({decontaminate.OP8_SQL})").fetchall())
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 24))
    x = np.concatenate([centres[rng.integers(0, 40, 900)] + rng.normal(scale=rng.uniform(0.05, 0.6), size=(900, 24)) for _ in range(2)])
    x = np.concatenate([x, x[:50], 3 * x[50:60], np.tile(x[7], (80, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [None] * 24), (5003, [float("nan")] * 24), (5004, [float("inf")] + [1.0] * 23), (5005, [1.0, 2.0]), (5006, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("list", F.lit("x")).withColumn("id", F.lit(1))
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    n = np.array([got[i].n_links for i in range(len(x))])
    assert n.sum() >= 0.99 * g.sum() and (n <= g.sum(1)).all()
    want = components(range(len(x)), zip(*(a.tolist() for a in np.nonzero(g))))
    assert np.mean([got[i].component_id == want[i] for i in want]) >= 0.99
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values()) and len(got) == len(rows) + len(odd)


def test_embeddings_recall_in_hundreds_of_lists(spark):
    rng = np.random.default_rng(21)
    a = rng.normal(size=(2000, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e = rng.normal(size=a.shape)
    e -= (e * a).sum(1, keepdims=True) * a
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.95, size=(2000, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * e])[rng.permutation(4000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df, sample=1000, per_list=8).collect()}  # 500 lists
    g = x @ x.T >= 0.9
    np.fill_diagonal(g, False)
    n = np.array([got[i] for i in range(len(x))])
    assert (n <= g.sum(1)).all()
    assert n.sum() >= 0.998 * g.sum(), n.sum() / g.sum()


@pytest.mark.parametrize(("n", "pairs", "per_list", "asked"), [(4000, 400, 10, 20), (16_384, 1500, 4, 500)])
def test_embeddings_recall_without_links_in_the_sample(spark, n, pairs, per_list, asked):
    """Random directions with some pairs at the threshold: few or none of the asking vectors have a link, at 400 and at 4096 lists."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.normal(size=(pairs, 64))
    e -= (e * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.93, size=(pairs, 1))
    x[pairs : 2 * pairs] = c * x[:pairs] + np.sqrt(1 - c * c) * e
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df, sample=6000, per_list=per_list, asked=asked).collect()}
    real = sum(int((x[at : at + 2048] @ x.T >= 0.9).sum()) for at in range(0, n, 2048)) - n
    assert real >= 2 * pairs and 0.99 * real <= sum(got.values()) <= real


def test_planted_partners_give_a_figure():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = embeddings.kmeans(x, 40)
    steps = [1, 2, 4, 8, 16, 40]
    found = embeddings.planted_steps(x, centres, 0.9, steps)
    assert (np.diff(found) >= 0).all() and found[-1] == 1 and found[0] < found[3]
    assert (embeddings.planted_steps(np.ones((3, 1)), np.ones((2, 1)), 0.9, [1, 2]) == 1).all()


def test_embeddings_edge_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_vectors(spark.createDataFrame([], schema)).count() == 0
    lone = embeddings.near_vectors(spark.createDataFrame([(4, None)], schema)).first()
    assert tuple(lone) == (4, 0, 4, True)
    two = sorted(map(tuple, embeddings.near_vectors(spark.createDataFrame([(4, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [0.0, 1.0])], schema)).collect()))
    assert two == [(2, 1, 2, True), (4, 1, 2, False), (9, 0, 9, True)]


def test_embeddings_of_several_lengths(spark):
    """Each length is searched by itself; none is left out for being rare."""
    rows = [(i, [1.0, float(i)]) for i in range(5)] + [(10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [2.0, 0.1, 0.0]), (13, [1.0]), (14, [-1.0]), (15, [0.3])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links = [(a, b) for a, x in rows for b, y in rows if a < b and len(x) == len(y) and np.dot(x, y) >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y)]
    want = components([i for i, _ in rows], links)
    assert got == {i: (sum(i in p for p in links), want[i]) for i, _ in rows} and got[10] == (2, 10) and got[15] == (1, 13)
