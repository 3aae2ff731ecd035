"""Queries of the operators that read each text on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .language_svm import fit, predicted
from .piece_sampling import sampled_pieces
from .queries import query
from .secret_scan import secret_spans
from .semi_crf import fit as fit_field
from .semi_crf import personal_spans
from .token_counts import token_counts


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def labelled(docs: DataFrame) -> DataFrame:
    """The rows a language model may learn from: those outside the held-out quarter."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


@query("op5_language_svm")
def op5_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(labelled(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return (docs.select("doc_id", held_out.alias("held_out"), predicted(F.col("text"), model, spark).alias("p"))
            .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score"))


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))


@query("op8_semi_crf_pii")
def op8_semi_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return personal_spans(docs, fit_field(docs))


@query("op10_piece_sampling")
def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces(documents(spark, sf_dir))
