"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents. run() writes each result as Parquet to the shared folder and reads it as the next
stage's docs, so a lost executor repeats part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import line_dedup, mixing, packing, quality, simhash
from tempora.llm.common import load, materialize, release, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = quality.fit(quality.statistics(docs), load(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that 10 or more of them hold."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    kept = line_dedup.drop_frequent_lines(docs, line_dedup.build_state(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of three or fewer differing bits, or by verified similarity."""
    small_batches(spark)
    return simhash.keep_one(docs.select(*COLUMNS), radius=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that tokens meet the target weights of source, language and topic."""
    small_batches(spark)
    return mixing.mix(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{k}")
        release(before)
    return docs


#: Fingerprints, the fitted classifier and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
