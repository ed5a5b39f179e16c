"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .jaccard import op7_ngram_jaccard
from .langid import op10_language_id
from .media import op1_media_columns
from .mixing import op6_mixing
from .nbsvm import op9_quality_classifier
from .packing import op4_pattern_packing
from .quality import SQL as QUALITY_SQL
from .quality import op2_quality_rules
from .store import op3_token_store
from .substring import op5_substring_dedup
from .toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_store": op3_token_store,
    "op4_pattern_packing": op4_pattern_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mixing": op6_mixing,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_toxicity": op8_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": QUALITY_SQL}
