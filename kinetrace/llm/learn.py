"""What the trained operators share: a bounded sample of labelled documents, and scores of all documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, discard, materialize, tune

#: Labelled documents that a model is fitted on, at most: those whose ids have the smallest hashes; and the bytes of text that they may have together.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20


def bounded(docs: DataFrame, chosen: DataFrame, label: str, limit: int = SAMPLE_BYTES) -> pd.DataFrame:
    """doc_id, the label and the text of the chosen documents (a bounded table of doc_id and label), in the order of a hash of their id and as far as their texts fit into `limit` bytes. Of several texts of one doc_id the least counts."""
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))
    found = materialize(found)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col(label)]
    sizes = np.cumsum([r[0] for r in found.orderBy(*order).select(F.coalesce(F.octet_length("text"), F.lit(0))).collect()])
    out = found.orderBy(*order).limit(int(np.searchsorted(sizes, limit, side="right"))).toPandas()
    discard(found)
    return out.sort_values(["doc_id", label]).reset_index(drop=True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int = SAMPLE, limit: int = SAMPLE_BYTES) -> pd.DataFrame:
    """text and label of at most `bound` labelled documents outside the held-out fold, of `limit` bytes together. Null labels are left out; a null text counts as empty."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc_of_id(F.col("doc_id")), F.lit(folds)) != held_out))
    chosen = rows.select("doc_id", F.col(label).alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    return bounded(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), chosen, "label", limit)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def scored(batch: pa.RecordBatch, score, held_out, at: float) -> pa.RecordBatch:
    """The four columns that a classifier returns."""
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held_out), pa.array(score, pa.float64()), pa.array((score >= at).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])


SCORES = "doc_id long, held_out boolean, score double, predicted int"
