"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

toxicity drops documents that the subword model calls toxic; near_copies keeps the least doc_id of each group of near copies; repeats removes passages of 20 words or more that started earlier in what is left; mixture samples what is left towards target weights; packing places its pieces in sequences. A stage works on all rows of its predecessor. SQL can't express the trained model or the tokenizer, so the stages are tested against brute force instead.

Odd rows: a null text counts as empty everywhere, an empty or blank one is a document like others; no stage but toxicity and mixture drops it. Rows with a null doc_id are never near copies or repeats, are drawn together, and are packed each. Rows that repeat a doc_id are judged each by their own text in toxicity, are one document in near_copies and mixture (they stay or go together), lose what an earlier row has in repeats (a row equal in words to an earlier one, 20 words or more, goes), and are packed each. Texts are read whole at any length. Empty tables pass as such, and columns besides those of documents are kept by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm.common import discard, materialize, tune
from kinetrace.llm.jaccard import keep_one
from kinetrace.llm.mixing import mix
from kinetrace.llm.packing import pack
from kinetrace.llm.substring import strip_repeats
from kinetrace.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return strip_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("mixture", mixture),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each leaves is written to the shared folder, and goes when the next has read it."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        discard(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
