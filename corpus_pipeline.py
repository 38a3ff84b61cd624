"""The corpus pipeline: documents to token digests in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept: texts that the quality rules
reject go; of equal texts one stays; of each group of near copies one stays; documents are kept at the rates that
bring the domains to their target weights; what is left is encoded. All but the last return the columns of documents.

With null ids, texts or sources a stage does what its operator's module says; an empty table passes through all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from takewise.llm import exact_dedup, mixing, quality, sentencepiece_codec, simhash
from takewise.llm.common import documents, forget, rewritten, small_batches, stage_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.filter_quality(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sentencepiece_codec.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing to target weights", target_weights),
    ("SentencePiece encoding", encoded),
]

#: SQL has neither XXH64 fingerprints nor SentencePiece; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table is removed when the next one's is written; the last one stays, as the result is read from it."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        folder = stage_folder(spark)
        docs = rewritten(stage(spark, docs, sf_dir), folder)
        if before:
            forget(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
