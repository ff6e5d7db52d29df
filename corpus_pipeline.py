"""Corpus pipeline: five stages over documents, each one of the operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's docs; all but the last return documents' columns.

In every stage an empty table gives an empty one, repeated rows are judged alike, and
columns beyond doc_id and text pass through whatever they are called, as do their nulls.
"""

from rasterweave.llm import decontaminate, jaccard, language, packing, quality
from rasterweave.llm.common import materialise


def language_id(spark, docs, sf_dir):
    """Documents without a language, or with less than 0.4 of their words in one, go; so do
    null and empty texts and those without a letter. A null lang or doc_id is only not learned from."""
    return language.keep_identified(docs)


def quality_classifier(spark, docs, sf_dir):
    """Documents that score below 0.3 go; null and empty texts are scored as one blank passage.
    Without labels all score 0.5 and stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark, docs, sf_dir):
    """Of each group joined by links of Jaccard 0.8 on five-word shingles the smallest doc_id stays,
    with all its rows; rows of a null doc_id or without words link with nothing and stay."""
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold 0.8 of a benchmark item's five-word shingles go; rows of a null
    doc_id or text stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark, docs, sf_dir):
    """Pieces of at most 1024 tokens with their sequences and offsets; a null or empty text is
    one piece, the end id, and a repeated row is packed as often as it comes."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The learned stages cannot be SQL; tests/llm runs each stage on its predecessor's output
#: against brute force, and holds run() to the stages one after another.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
