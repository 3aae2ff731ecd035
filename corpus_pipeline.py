"""Corpus pipeline over ``documents``: each stage takes (spark, docs, sf_dir); its result is written and
read again as the next one's docs. All stages but the last return the columns of ``documents``.

1. language ID: documents whose language cannot be told go.
2. exact dedup: of equal texts the one with the largest doc_id stays.
3. MinHash near-dedup: of each group of near copies the smallest doc_id stays.
4. secret scans: every span found is masked in the text, and ``n_chars`` follows the text.
5. packing: every document that is left is packed into training sequences.

Defined results: null columns other than the text pass through; null or empty text is undetermined
and goes in stage 1; an empty table gives no pieces; further columns pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docshelf.llm.common import documents, written
from docshelf.llm.exact_dedup import drop_copies
from docshelf.llm.language_svm import fit, identify
from docshelf.llm.minhash_bayes import drop_near_copies
from docshelf.llm.packing import pack
from docshelf.llm.q_text import labelled
from docshelf.llm.secret_scan import mask_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identify(docs, fit(labelled(docs)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = docs.withColumn("text", mask_secrets(F.col("text")))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("secret_scan", secret_scan), ("packing", packing)]

# The stages learn a classifier, hash shingles and run a tokenizer, which SQL cannot express; tests
# hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
