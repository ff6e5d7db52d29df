"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles. Two documents can only reach the
threshold when they share at least t = ceil(threshold * n) shingles of each; then,
with all sets in one global order, the first n - t + l shingles of both (their
l-prefixes) share at least l. Each document picks its own l: rare shingles are cheap with l
= 1; where a prefix holds frequent shingles, a longer prefix that asks for more
shared ones costs less than the candidates it avoids. A pair is a candidate when
its prefixes share at least the smaller l of the two, and candidates are verified on
the shingles themselves. Of two documents the smaller shares as many within its index prefix, the first
n - ceil(2 * threshold / (1 + threshold) * n) + l shingles, so a shingle that is in no document's index prefix
is nobody's candidate and goes: that is where what all pages of a template have in common ends.

Frequent shingles come last in the order. Documents of equal word sequences are joined once, by their smallest id.
Components need no more links than join them: each prefix shingle first links its
documents to the smallest of them. What is left lies between components: the documents of a
shingle that more than one component has meet in pairs of blocks, where the prefixes' shared
shingles are counted; only documents with a candidate in another component are compared in
full there, and a block pair gives a forest of its links, never the pairs. Blocks of a group's main
component never meet each other. All links are verified on the words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialise, prepare, release, sized_join, tidy

#: Characters whose shingles a worker has in hand at a time.
SLICE = 250_000
#: Shingles gathered in a task before their counts are handed on. Counts below 3 of a
#: chunk are not, and at most FREQUENT shingles (16 bytes each) are told apart: both change
#: the order of shingles and the choice of l, so the cost, never a link.
CHUNK = 2_000_000
FREQUENT = 400_000
#: A prefix shingle of more documents is dealt to as many tasks as this goes into it.
SPLIT = 10_000
#: Shingles of at most FEW documents count their pairs in a join, the others in blocks of BLOCK documents;
#: both ask for the same number of shared prefix shingles.
FEW, BLOCK = 32, 256
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A meta number is the set's size times LONG, plus l.
LONG = 1 << 24
_MIX = np.random.default_rng(23).integers(1, 2**63, 64 * 256, dtype=np.uint64)
SPACE = re.compile(r"[ \t-\r]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, first word of each text and the end)."""
    raw = [b"" if t is None else t.encode() for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    low = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    start = ~space
    start[1:] &= space[:-1]
    words = np.flatnonzero(start)
    bounds = np.concatenate([[0], np.searchsorted(words, ends)])
    if not len(words):
        return np.zeros(0, np.uint64), bounds
    at = np.arange(len(buf) - words[0]) - np.repeat(words - words[0], np.diff(np.append(words, len(buf))))
    letters = _MIX[(at & 63) * 256 + low[words[0] :]]
    far = at > 63
    if far.any():
        letters[far] *= 2 * (at[far] >> 6).astype(np.uint64) + np.uint64(1)
    letters[space[words[0] :]] = 0
    return mix(np.add.reduceat(letters, words - words[0])), bounds


def shingle_sets(texts: list[str | None], k: int) -> Iterator[tuple[np.ndarray, tuple[int, int]]]:
    """For each text its sorted distinct shingle hashes and a 128-bit hash of its words."""
    h, bounds = word_hashes(texts)
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        s += h[j : len(h) - k + 1 + j] * np.uint64(2 * j + 3) ** np.uint64(5)
    s = mix(s)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
    one, two = mix(h + place * _M1), mix(h ^ (place * _M2 + np.uint64(1)))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a == b:
            yield np.zeros(0, np.uint64), (0, 0)
            continue
        key = (int(one[a:b].sum(dtype=np.uint64).view(np.int64)), int(two[a:b].sum(dtype=np.uint64).view(np.int64)))
        if b - a >= k:
            yield np.unique(s[a : b - k + 1]), key
        else:
            yield np.array([key[0] ^ (b - a)], np.int64).view(np.uint64), key


def slices(ids, texts) -> Iterator[tuple[list, list]]:
    some, own, size = [], [], 0
    for i, t in zip(ids, texts):
        own.append(i), some.append(t)
        size += len(t or "")
        if size >= SLICE:
            yield own, some
            some, own, size = [], [], 0
    if some:
        yield own, some


def _scan(k: int):
    """kind 0: (doc_id, words' hash, shingles); kind 1: (shingle, documents)."""

    def run(batches):
        release()
        gathered, size = [], 0

        def hand_on():
            values, counts = np.unique(np.concatenate(gathered), return_counts=True)
            often = counts >= 3
            return pd.DataFrame({"kind": 1, "a": values[often].view(np.int64), "b": counts[often], "c": 0, "n": 0})

        for batch in batches:
            for ids, texts in slices(batch["doc_id"], batch["text"]):
                rows = []
                for i, (found, key) in zip(ids, shingle_sets(texts, k)):
                    rows.append((0, i, *key, len(found)))
                    gathered.append(found)
                    size += len(found)
                out = pd.DataFrame(rows, columns=["kind", "a", "b", "c", "n"])
                out["a"] = out["a"].astype("Int64")
                yield out
                if size >= CHUNK:
                    yield hand_on()
                    gathered, size = [], 0
        if gathered:
            yield hand_on()

    return run


def prefixes_of(batches, k: int, percent: int, sent):
    """For each slice of texts (ids, prefix shingles, sizes and l as meta, document counts, index prefix lengths) of those with shingles."""
    release()
    keys, counts = sent.value
    for batch in batches:
        for ids, texts in slices(batch["doc_id"], batch["text"]):
            sets = [s for s, _ in shingle_sets(texts, k)]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            often = np.zeros(len(flat), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                often = np.where(keys[at] == flat, counts[at], 0)
            out, begin = [], 0
            for i, s in zip(ids, sets):
                n = len(s)
                df = often[begin : begin + n]
                begin += n
                if n:
                    order = np.argsort(df, kind="stable")
                    length, l = choose(df[order], n, -(-percent * n // 100))
                    own = n - -(-2 * percent * n // (100 + percent)) + l
                    out.append((i, s[order[:length]], n * LONG + l, df[order[:length]], min(own, length)))
            if out:
                yield list(zip(*out))


def _prefixes(k: int, percent: int, sent):
    """One row a shingle: (token, doc_id, meta, parts, own), own in the index prefix."""

    def run(batches):
        for ids, tokens, metas, dfs, own in prefixes_of(batches, k, percent, sent):
            size = [len(t) for t in tokens]
            inside = np.concatenate([np.arange(n) < m for n, m in zip(size, own)])
            yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "doc_id": np.repeat(ids, size), "meta": np.repeat(metas, size), "parts": (1 + np.concatenate(dfs) // SPLIT).astype(np.int32), "own": inside})

    return run


def _packed_prefixes(k: int, percent: int, sent):
    """One row a document: (doc_id, meta, tokens)."""

    def run(batches):
        for ids, tokens, metas, _, _ in prefixes_of(batches, k, percent, sent):
            yield pd.DataFrame({"doc_id": ids, "meta": metas, "tokens": [t.tobytes() for t in tokens]})

    return run


def choose(df: np.ndarray, n: int, need: int) -> tuple[int, int]:
    """Prefix length and l of least estimated cost, for document counts ``df`` in
    the global order: entries probed, each taken to meet one document more than is known, as
    rare shingles are not counted; when l shared shingles are asked for at most a share 1 / l of
    those meetings is a candidate, which costs a comparison of n shingles."""
    base, l = n - need, np.arange(1, need + 1)
    met = np.cumsum(df[: base + len(l)] + 1)[base:]
    best = int((met * (1 + n / (64 * l))).argmin()) + 1
    return base + best, best


def shingles_of(text: str, k: int) -> set:
    """The distinct shingles themselves, as word tuples."""
    words = [w for w in SPACE.split(text.translate(UPPER)) if w]
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(k))))


def _verify(k: int, percent: int):
    def run(batches):
        import zstandard

        plain = zstandard.ZstdDecompressor()
        held: dict = {}

        def of(i, data):
            if i not in held:
                if len(held) >= 256:
                    held.clear()
                held[i] = shingles_of(plain.decompress(data).decode(), k)
            return held[i]

        for batch in batches:
            keep = []
            for u, v, a, b in zip(batch["u"], batch["v"], batch["a"], batch["b"]):
                x, y = of(u, a), of(v, b)
                both = len(x & y)
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["u", "v"]]

    return run


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose texts reach the threshold."""
    ids = materialise(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "pair-docs")

    def squeeze(batches):
        import zstandard

        press = zstandard.ZstdCompressor(1)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "data": [press.compress(t.encode()) for t in batch["text"]]})

    own = sized_join(docs, ids, "doc_id", "left_semi")
    data = materialise(own.mapInPandas(tidy(squeeze), "doc_id long, data binary"), "pair-texts")
    left = data.select(F.col("doc_id").alias("u"), F.col("data").alias("a"))
    right = data.select(F.col("doc_id").alias("v"), F.col("data").alias("b"))
    both = pairs.select("u", "v").join(right, "v").join(left, "u").select("u", "v", "a", "b")
    return both.mapInPandas(tidy(_verify(k, percent)), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Texts are lower-cased A-Z and split at ASCII white space. Documents link when 100
    * intersection >= percent * union; null, empty and wordless texts have 0
    shingles and link with nothing; with fewer than k words the whole sequence is the one
    shingle. Rows of one doc_id are one document: it links when any of its texts does, each row has
    its own text's n_shingles and all have the document's component. A null doc_id is returned with a
    null component and links with nothing. An empty table gives no rows. Only the id and text columns
    are read, whatever others are called. Sets hold 64-bit hashes of shingles; every link is verified on the words.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scan = materialise(d.mapInPandas(tidy(_scan(k)), "kind int, a long, b long, c long, n int"), "scan")
    signatures = scan.where("kind = 0").select(F.col("a").alias("doc_id"), "b", "c", "n")

    # documents of one word sequence stand for their smallest id
    known = signatures.where("n > 0 and doc_id is not null")
    groups = known.groupBy("b", "c").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = materialise(groups.where("first <> last").select("b", "c", "first"), "sequences")
    copies = known.join(copied, ["b", "c"]).where("doc_id <> first").select("doc_id", F.col("first").alias("of")).distinct()
    copies = materialise(copies, "copies")
    several = known.groupBy("doc_id").agg(F.min(F.struct("b", "c")).alias("x"), F.max(F.struct("b", "c")).alias("y")).where("x <> y").select("doc_id")
    gone = materialise(copies.select("doc_id").distinct().join(several, "doc_id", "left_anti"), "copied-docs")
    single = sized_join(d.where("doc_id is not null and text is not null"), gone, "doc_id", "left_anti")

    sent = spark.sparkContext.broadcast(frequent(scan))
    posts = single.mapInPandas(tidy(_prefixes(k, percent, sent)), "token long, doc_id long, meta long, parts int, own boolean")
    posts = posts.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), "parts")).otherwise(0).cast("int"))
    share = Window.partitionBy("token", "part")
    posts = posts.select("*", F.min(F.struct("doc_id", "meta")).over(share).alias("low"), F.max("doc_id").over(share).alias("top"), F.max("own").over(share).alias("asked"))
    posts = posts.where("low.doc_id <> top and asked or parts > 1").select("token", "doc_id", "meta", "parts", "part", "asked", F.col("low.doc_id").alias("hub"), F.col("low.meta").alias("hub_meta"))
    posts = materialise(posts, "prefixes")
    # parts of one shingle are joined by their hubs, few rows
    hubs = posts.where("parts > 1 and doc_id = hub").groupBy("token").agg(F.min(F.struct("doc_id", "meta")).alias("root"), F.max("asked").alias("wanted"))
    hubs = materialise(hubs.where("wanted").drop("wanted"), "hot-shingles")
    hot = sized_join(posts.where("parts > 1"), hubs, "token", "inner")

    star = posts.where("parts = 1").select("doc_id", "meta", "hub", "hub_meta").unionByName(hot.select("doc_id", "meta", "hub", "hub_meta")).where("doc_id <> hub").select(F.col("hub").alias("u"), F.col("doc_id").alias("v"), F.col("hub_meta").alias("um"), F.col("meta").alias("vm"))
    roots = hot.where("doc_id = hub and doc_id <> root.doc_id").select(F.col("root.doc_id").alias("u"), F.col("doc_id").alias("v"), F.col("root.meta").alias("um"), F.col("meta").alias("vm"))
    links = candidates(star.unionByName(roots), percent)
    links = materialise(verified(materialise(links, "pairs"), single, k, percent), "links")
    comps = materialise(connected_components(links), "components")

    # what is left lies between components: only shingles that more than one has
    grouped = posts.where("parts = 1").select("token", "doc_id", "meta", "hub").unionByName(hot.select("token", "doc_id", "meta", F.col("root.doc_id").alias("hub")))
    placed = grouped.join(comps, F.col("doc_id") == F.col("node"), "left").select("token", "doc_id", "meta", "hub", F.coalesce("component", "doc_id").alias("comp"))
    tokens = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("docs")).where("low <> high").select("token", "docs")
    placed = materialise(sized_join(placed, materialise(tokens, "open-shingles"), "token", "inner"), "open-prefixes")
    # a pair that shares a shingle of many documents is settled in their blocks; others share only shingles of few
    few = placed.where(f"docs <= {FEW}")
    a, b = (few.select("token", *[F.col(c).alias(x + y) for c, y in (("doc_id", ""), ("meta", "m"), ("comp", "c"))]) for x in "uv")
    more = candidates(a.join(b, "token").where("uc < vc").select("u", "v", "um", "vm"), percent)
    more = more.unionByName(between(placed.where(f"docs > {FEW}"), single, k, percent, sent)).distinct()
    more = materialise(verified(materialise(more, "pairs"), single, k, percent), "links")
    known_links = comps.where("node <> component").select(F.col("component").alias("u"), F.col("node").alias("v"))
    edges = known_links.unionByName(more).unionByName(copies.select(F.col("of").alias("u"), F.col("doc_id").alias("v")))
    comps = connected_components(edges)
    out = signatures.join(comps, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def between(placed: DataFrame, docs: DataFrame, k: int, percent: int, sent) -> DataFrame:
    """Links (u, v) that join all that is linked across components within each hub's members.

    All documents of a shingle have its hub, so any two that share one meet there. A group's
    members are the main ones, those of the hub's component, and the rest, each dealt to blocks
    by hash; pairs of blocks meet unless both are of the main ones. First the
    prefixes meet, and say which documents have a candidate in another component; then these meet with their sets.
    """
    members = materialise(placed.select("hub", "doc_id", "comp").distinct(), "open-members")
    per = members.groupBy("hub", "comp").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("hub")).alias("main"))
    sizes = per.groupBy("hub").agg(F.sum(F.when(F.col("main"), F.col("n"))).alias("m"), F.coalesce(F.sum(F.when(~F.col("main"), F.col("n"))), F.lit(0)).alias("r"), F.max(F.when(F.col("main"), F.col("comp"))).alias("main")).where("r > 0")
    whole = F.col("m") + F.col("r") <= BLOCK
    sizes = sizes.select("hub", "main", F.ceil(F.col("m") / BLOCK).cast("int").alias("mains"), F.when(whole, 0).otherwise(F.ceil(F.col("r") / BLOCK)).cast("int").alias("rests"))
    placed = sized_join(members, materialise(sizes, "group-blocks"), "hub", "inner")
    own = F.when((F.col("comp") == F.col("main")) | (F.col("rests") == 0), F.pmod(F.xxhash64("doc_id"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("doc_id"), F.greatest("rests", F.lit(1)))).cast("int")
    placed = placed.withColumn("block", own)
    meets = F.expr("explode(CASE WHEN rests = 0 THEN array(0) WHEN block < mains THEN sequence(mains, mains + rests - 1) ELSE sequence(0, mains + rests - 1) END)")
    placed = placed.select("hub", "doc_id", "comp", "block", meets.alias("other")).select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "comp", "block")
    placed = materialise(placed, "block-members")

    ids = materialise(members.select("doc_id").distinct(), "block-docs")
    prefixes = sized_join(docs, ids, "doc_id", "left_semi").mapInPandas(tidy(_packed_prefixes(k, percent, sent)), "doc_id long, meta long, tokens binary")

    def shared(own: list[np.ndarray]) -> np.ndarray:
        """How many elements each two of the sets share."""
        _, place, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(own)), [len(s) for s in own])
        often = np.flatnonzero(counts > 1)  # no other element adds to an overlap
        column = np.full(len(counts), -1)
        column[often] = np.arange(len(often))
        place = column[place]
        both = np.zeros((len(own), len(own)), np.float32)
        for at in range(0, len(often), 4096):
            here = (place >= at) & (place < at + 4096)
            m = np.zeros((len(own), min(4096, len(often) - at)), np.float32)
            m[doc[here], place[here] - at] = 1
            both += m @ m.T
        return both.astype(np.int64)

    def apart(rows: pd.DataFrame) -> np.ndarray:
        """Pairs that this pair of blocks has to settle: across components and, of two blocks, across those."""
        comp, block = rows["comp"].to_numpy(), rows["block"].to_numpy()
        open_ = comp[:, None] != comp[None]
        return open_ if rows["i"].iloc[0] == rows["j"].iloc[0] else open_ & (block[:, None] != block[None])

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        open_ = apart(rows)
        if open_.any():
            n, l = rows["meta"].to_numpy() // LONG, rows["meta"].to_numpy() % LONG
            open_ &= 100 * np.minimum(n[:, None], n[None]) >= percent * np.maximum(n[:, None], n[None])
            open_ &= shared([np.frombuffer(t, np.uint64) for t in rows["tokens"]]) >= np.minimum(l[:, None], l[None])
        found = open_.any(1)
        if len(rows) >= BLOCK:
            del open_
            release()
        return rows.loc[found, ["hub", "i", "j", "doc_id", "comp", "block"]]

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(b, np.uint64) for b in rows["s"]]
        n, both = np.array([len(s) for s in own], np.int64), shared(own)
        linked = np.triu(apart(rows) & (both > 0) & (100 * both >= percent * (n[:, None] + n[None] - both)), 1)
        u, v = np.nonzero(linked)
        del own, both, linked
        if len(rows) >= BLOCK:
            release()
        return pd.DataFrame(forest(rows["doc_id"].to_numpy(), u, v), columns=["u", "v"]).astype("int64")

    def sets(batches):
        for batch in batches:
            for own, texts in slices(batch["doc_id"], batch["text"]):
                yield pd.DataFrame({"doc_id": own, "s": [s.tobytes() for s, _ in shingle_sets(texts, k)]})

    keys, schema = ["hub", "i", "j"], "hub long, i int, j int, doc_id long, comp long, block int"
    asked = placed.join(prefixes, "doc_id").groupBy(*keys).applyInPandas(ask, schema)
    asked = materialise(asked, "block-candidates")
    ids = materialise(asked.select("doc_id").distinct(), "block-docs")
    data = sized_join(docs, ids, "doc_id", "left_semi").mapInPandas(tidy(sets), "doc_id long, s binary")
    return asked.join(data, "doc_id").groupBy(*keys).applyInPandas(meet, "u long, v long").distinct()


def forest(names: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Some of the edges (u, v), places in ``names``: as few as join what all of them join."""
    label, out = np.arange(len(names)), []
    while True:
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
        if not len(u):
            return out
        first = np.full(len(names), len(u))  # each part takes its first edge
        for end in (u, v):
            np.minimum.at(first, label[end], np.arange(len(u)))
        taken = np.unique(first[first < len(u)])
        out += zip(names[u[taken]].tolist(), names[v[taken]].tolist())
        while True:
            low, new = np.minimum(label[u[taken]], label[v[taken]]), label.copy()
            np.minimum.at(new, label[u[taken]], low)
            np.minimum.at(new, label[v[taken]], low)
            new = new[new][label]
            if (new == label).all():
                break
            label = new


def candidates(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs of sizes that can link and whose prefixes share the smaller l."""
    n, l = f"{{0}} div {LONG}", f"{{0}} % {LONG}"
    fits = f"100 * least({n.format('um')}, {n.format('vm')}) >= {percent} * greatest({n.format('um')}, {n.format('vm')})"
    counted = shared.where(fits).groupBy("u", "v").agg(F.count("*").alias("hits"), F.min(F.least(F.expr(l.format("um")), F.expr(l.format("vm")))).alias("ask"))
    return counted.where("hits >= ask").select("u", "v")


def frequent(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, about FREQUENT, sorted, with their counts: whole steps of an eighth of a doubling
    from the top, and of the step that is too large for all of it as many as are missing, by hash."""
    totals = scan.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n"))
    totals = materialise(totals.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "counts")
    held, wanted = 0, F.lit(False)
    for r in totals.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 8 rows a doubling
        share = min(1.0, (FREQUENT - held) / r["count"])
        inside = F.col("step") == r["step"]
        wanted = wanted | (inside if share == 1 else inside & (F.pmod(F.xxhash64("a"), F.lit(1 << 20)) < int(share * (1 << 20))))
        held += r["count"]
        if held >= FREQUENT:
            break
    got = totals.where(wanted).select("a", "n").toPandas()
    keys = got["a"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["n"].to_numpy(np.int64)[order]


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document, the smallest id, of each near-duplicate group."""
    groups = near_duplicates(docs, k, percent)
    gone = materialise(groups.where("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    return sized_join(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def op2_ngram_jaccard(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
