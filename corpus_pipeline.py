"""The corpus pipeline: from documents to token ids, a stage at a time.

Toxic documents go; of equal texts one stays, then one of each group of near
copies; sources are mixed to less uneven weights; and the mixture is encoded.
Each stage's rows are written as Parquet and read again as the next one's docs.

Defined cases: a null or empty text is scored by the model's bias; equal ones are
copies of each other, and the one that stays is encoded to no ids; a very long
text goes through every stage whole; rows with a null doc_id come after all others
among copies, are never near copies, and are mixed and encoded like any others; of
repeated rows one stays; a null source is a source of its own; without labels, or
with labels of one kind, no text is told toxic but by their share; an empty table
gives no rows; columns beside text, source and doc_id pass through all stages but
the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netquarry.llm import bpe, common, exact_dedup, jaccard_join, mixing, queries
from netquarry.llm import toxicity as mil


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model scores below its threshold; it learns from the labels of documents that are still there."""
    return mil.keep(docs, mil.trained(docs, queries.table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return jaccard_join.keep(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; the rarer sources up to twice as often as the commonest."""
    return mixing.keep(docs, repeats=2.0, tokenizer=(queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pre_tokens()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_tokens and digests of the ids and of what they decode to, for each document of the mixture."""
    return bpe.encode_digests(docs, queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pre_tokens())


STAGES = [("toxicity", toxicity), ("exact_dedup", dedup), ("ngram_jaccard", near_dedup), ("mixing", mix), ("bpe", encode)]

#: Trained scores and merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
