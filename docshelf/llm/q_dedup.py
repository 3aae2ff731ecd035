"""Queries of the dedup operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .exact_dedup import exact_groups
from .minhash_bayes import near_duplicates
from .queries import query
from .substring_dedup import SpanOptions, remove_repeats


@query("op9_exact_dedup", sql="""
    SELECT doc_id,
           max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
           count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


@query("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("row_key")


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), opts=SpanOptions(lengthen=True))
