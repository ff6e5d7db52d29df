"""Benchmark decontamination by size-partitioned MinHash containment, on built-in
functions only.

A test item of n distinct word shingles is contained in a document when at least
``threshold`` of them occur there. Ordering an item's shingles by a random hash,
the s = n - ceil(threshold * n) + 1 smallest (its bottom-s MinHash sketch) must
hold at least one shingle of every document that contains it: at most n -
ceil(threshold * n) can be missing. So meeting documents on sketches loses
nothing. Items are partitioned by size (powers of two); the partition's lower
bound says how many shingles a document needs to be worth probing, and each
item's sketch length follows from its size. Candidates are then verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sized_join


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, words; an explode of one element keeps the split out of lambdas."""
    return df.select(*keep, F.explode(F.array(words_of(F.col(text)))).alias("words")).where("size(words) > 0")


def hashed(k: int) -> Column:
    """Hashes of the k-word shingles of column ``wh`` (word hashes); with fewer
    words, of all as one."""
    at = ", ".join(f"element_at(wh, i + {j})" for j in range(1, k + 1))
    return F.expr(f"CASE WHEN size(wh) >= {k} THEN transform(sequence(0, size(wh) - {k}), i -> xxhash64({at})) ELSE array(xxhash64(wh)) END")


def strings(k: int) -> Column:
    return F.expr(
        f"array_distinct(CASE WHEN size(words) >= {k} THEN transform(sequence(1, size(words) - {k - 1}), i -> array_join(slice(words, i, {k}), ' ')) ELSE array(array_join(words, ' ')) END)"
    )


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item contained in
    a document by at least ``threshold`` of its distinct k-word shingles.

    Words are lower-cased runs of letters and digits; items or documents of
    fewer than k words have one shingle, all their words. Null, empty and wordless texts
    match nothing. Repeated ids are distinct rows merged by id: a pair appears
    once with its largest overlap; a null doc_id contains nothing. Empty tables give an empty result. Only
    the id and text columns are read.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    i = with_words(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), "text", "item_id")
    i = i.select("item_id", strings(k).alias("item_shingles"), F.expr("transform(words, w -> xxhash64(w))").alias("wh"))
    i = i.select("item_id", "item_shingles", F.array_sort(F.array_distinct(hashed(k))).alias("hashes"))
    n = F.size("item_shingles")
    need = F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")
    i = materialise(i.select("item_id", "item_shingles", "hashes", n.alias("n_item"), need.alias("need")), "items")

    # power-of-two size partitions: documents below the partition's bound skip it
    sketch = i.select(
        "item_id",
        F.expr(f"cast(ceil(pow(2, floor(log2(n_item))) * {threshold} - 1e-9) as int)").alias("bound"),
        F.explode(F.expr("slice(hashes, 1, greatest(1, size(hashes) - need + 1))")).alias("h"),
    )
    sketch = materialise(sketch, "sketch")
    wh = with_words(d, "text", "doc_id").select("doc_id", F.explode(F.array(F.expr("transform(words, w -> xxhash64(w))"))).alias("wh"))
    probes = wh.select("doc_id", F.size("wh").alias("n_words"), F.explode(hashed(k)).alias("h"))
    hits = sized_join(probes, sketch, "h", "inner").where(f"greatest(n_words - {k - 1}, 1) >= bound")
    pairs = materialise(hits.select("doc_id", "item_id").distinct(), "candidates")

    ids = materialise(pairs.select("doc_id").distinct(), "candidate-docs")
    texts = with_words(sized_join(d, ids, "doc_id", "left_semi"), "text", "doc_id").select("doc_id", strings(k).alias("doc_shingles"))
    full = i.select("item_id", "item_shingles", "n_item", "need")
    checked = sized_join(sized_join(texts, pairs, "doc_id", "inner"), full, "item_id", "inner")
    shared = F.size(F.array_intersect("item_shingles", "doc_shingles"))
    return (
        checked.select("doc_id", "item_id", "n_item", "need", shared.alias("n_shared"))
        .where("n_shared >= need")
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
        .select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    bad = materialise(contained_items(docs, items).select("doc_id").distinct(), "contaminated")
    return sized_join(docs, bad, "doc_id", "left_anti").select(*docs.columns)


def op8_benchmark_decontamination(spark, sf_dir):
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM dw WHERE len(w) > 0),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
si AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY 1)
SELECT doc_id, item_id, CAST(any_value(n_item) AS INT) AS n_item, CAST(count(*) AS INT) AS n_shared, count(*) / any_value(n_item) AS containment
FROM ds JOIN si USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil(any_value(n_item) * 0.8 - 1e-9)
"""
