"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again for the next.

toxicity: documents that score 0.3 or more go. quality_rules: documents that fail the base rules or their language's
perplexity band go. ngram_join: one document of each group of near copies (5-word shingles, Jaccard of 0.8 or
more) stays. substring_dedup: repeated paragraphs and passages go from all documents but the first. packing: the texts as
sequences.

A stage's result has been written when the next stage is called. So each stage begins by deleting the tables that the one
before has left in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarmill.llm import ngram_join, packing, paragraphs, quality, registry, toxicity
from sugarmill.llm.common import BATCH, BATCH_SETTING, collected, removed, table, written

#: Words in the token cache of a packing worker: the executors' memory is shared with what the stages before have grown to.
CACHE_WORDS = 200_000
_LEFT: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the one before has left; rows go to Python workers in small batches from then on."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        removed(spark, _LEFT)
        _LEFT.clear()
        spark.conf.set(BATCH_SETTING, BATCH)
        with collected() as paths:
            out = f(spark, docs, sf_dir)
        _LEFT.extend(paths)
        return out

    return run_stage



@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score keeps."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return ngram_join.keep_one(docs, n=5, percent=80)


@stage
def drop_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without paragraphs that stand in an earlier one."""
    return paragraphs.remove(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    pieces = packing.pack(docs, registry.tokenizer_path(), cache_words=CACHE_WORDS, outlives=False)  # the workers go on with other work
    return pieces.select("doc_id", "start", "length", packing.ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", drop_repeated_paragraphs),
    ("packing", pack_sequences),
]

#: Fitted models and token ids are beyond SQL; tests/llm/test_pipeline.py compares with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES:
        docs = written(apply(spark, docs, sf_dir))
    return docs
