"""A corpus from raw documents: quality, near copies, repeated strings, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and all that the one before has kept; all but the last return the columns of
``documents``. Null texts count as empty and null ids, sources and languages as values of their own; rows that repeat are one
group of copies; empty tables give empty results; extra columns of any name are carried along. The operators' docstrings
say more. No DuckDB SQL expresses the stages (a fitted model, sketches, hashes by seed), so ``ORACLE_SQL`` is None;
tests hold the stages against brute force.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm import bpe, minhash, mixing, quality, suffix_dedup
from penprint.llm.common import doc_key, dropped, id_bound_join, kept, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50
OWN = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(stage: Stage) -> Stage:
    """Columns beside those of ``documents`` go through the stage under names that nothing in it has."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        return stage(spark, docs.toDF(*[c if c in OWN else f"__extra{i}" for i, c in enumerate(names)]), sf_dir).toDF(*names)

    return run_stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted_rows(docs, table(spark, sf_dir, "labels"))


@_aside
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; of rows that repeat, one."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    rows = docs.withColumn("__key", doc_key("doc_id", "text"))
    # documents that go are fewer than those that stay
    gone, gone_path = kept(found.where("not kept").select(F.col("key").alias("__key")).distinct())
    rows = id_bound_join(rows, gone, gone_path, "__key", "left_anti")
    # rows of one key that repeat are few; those are thinned, the others pass
    often, often_path = kept(found.where("kept").groupBy(F.col("key").alias("__key")).count().where("count > 1").select("__key"))
    if often.isEmpty():
        return rows.select(*docs.columns)
    once = id_bound_join(rows, often, often_path, "__key", "left_anti").select(*docs.columns)
    return once.unionByName(rows.join(often, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns))


@_aside
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more (or of 400 bytes) that occur again are cut out of the texts; ``n_chars`` follows.

    They are found as strings of 200 bytes, less than 50 words take, so that each lies in a repeat with all its words.
    """
    cut = suffix_dedup.remove_repeats(docs, PASSAGE_BYTES, words=PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


@_aside
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's tokens, and of the bytes that they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_copies), ("substring_dedup", drop_repeats), ("mix", mix), ("tokens", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    last = None
    for _, stage in STAGES:
        docs, path = kept(stage(spark, docs, sf_dir))
        if last:
            dropped(spark, last)
        last = path
    return docs
