"""A training corpus from raw documents: each stage works on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphlake.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from glyphlake.llm.common import Fence, load, scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it learns from the table's own labels."""
    return toxicity.keep_clean(docs.select(*COLUMNS), load(spark, sf_dir, "labels"))


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs.select(*COLUMNS))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that is left."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean_words),
    ("exact_dedup", one_of_each_text),
    ("simhash", one_of_each_group),
    ("decontamination", without_benchmark),
    ("byte_bpe", token_ids),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and reread; what a stage reads is deleted when the next one's rows are there."""
    docs, before = load(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scope() as keep:
            written = Fence(stage(spark, docs, sf_dir))
            keep(written)
        if before is not None:
            before.release()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
