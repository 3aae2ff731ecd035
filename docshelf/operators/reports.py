"""Run reports.

All reports are single aggregations over a results table
``(path, filename, category, confidence_pct, is_low, ...)``; partial
aggregation keeps them cheap whatever the size of a category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import options as O
from ..functions.ordinal import with_row_number


def category_counts(results: DataFrame, categories: DataFrame) -> DataFrame:
    """Files per category, every configured category present.

    ``categories(category)``; result categories outside it are added. Columns
    ``category, n_files, n_low, avg_confidence``; sort by ``category`` to print.
    """
    counts = results.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("is_low")).alias("n_low"),
        F.avg("confidence_pct").alias("avg_confidence"),
    )
    return (
        categories.select("category").distinct()
        .join(counts, ["category"], "full_outer")
        .select(
            "category",
            F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files"),
            F.coalesce("n_low", F.lit(0)).cast("bigint").alias("n_low"),
            F.coalesce(F.round("avg_confidence", 2), F.lit(0.0)).alias("avg_confidence"),
        )
    )


def run_stats(results: DataFrame, duplicates: DataFrame | None = None, errors: DataFrame | None = None,
              dry_run: bool = False) -> DataFrame:
    """One row: total_files, moved, duplicates, errors, low_confidence (G1).

    ``results`` are the classified files (each is moved, or counted as moved
    in a dry run); ``duplicates`` and ``errors`` are the skipped files.
    """
    res = results.agg(F.count(F.lit(1)).alias("classified"), F.count_if(F.col("is_low")).alias("low_confidence"))
    dup = (duplicates.agg(F.count(F.lit(1)).alias("duplicates")) if duplicates is not None
           else results.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("duplicates")))
    err = (errors.agg(F.count(F.lit(1)).alias("errors")) if errors is not None
           else results.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("errors")))
    return res.crossJoin(dup).crossJoin(err).select(
        (F.col("classified") + F.col("duplicates") + F.col("errors")).cast("bigint").alias("total_files"),
        F.col("classified").cast("bigint").alias("moved"),
        F.col("duplicates").cast("bigint").alias("duplicates"),
        F.col("errors").cast("bigint").alias("errors"),
        F.col("low_confidence").cast("bigint").alias("low_confidence"),
    )


def result_metrics(results: DataFrame) -> DataFrame:
    """total, average confidence, low count, renamed count."""
    renamed = F.col("new_name").isNotNull() & (F.col("new_name") != F.col("filename"))
    return results.agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.round(F.avg("confidence_pct"), 2).alias("avg_confidence"),
        F.count_if(F.col("is_low")).cast("bigint").alias("n_low"),
        F.count_if(renamed).cast("bigint").alias("n_renamed"),
    )


def status_label(is_low: str = "is_low", overridden: str | None = "overridden"):
    """``Manually overridden`` / ``Low confidence`` / ``Confident``."""
    c = F.when(F.col(is_low), F.lit(O.STATUS_LOW)).otherwise(F.lit(O.STATUS_CONFIDENT))
    if overridden:
        c = F.when(F.coalesce(F.col(overridden), F.lit(False)), F.lit(O.STATUS_OVERRIDDEN)).otherwise(c)
    return c


def export_rows(results: DataFrame, order_cols: list[str]) -> DataFrame:
    """Numbered export rows (G6, A8): ``#`` from 1 in result order plus display columns.

    Numbering is distributed (:func:`..functions.ordinal.with_row_number`).
    """
    numbered = with_row_number(results, order_cols)
    return numbered.select(
        "row_no",
        F.col("filename").alias("file"),
        F.coalesce(F.col("new_name"), F.col("filename")).alias("new_name"),
        "category",
        F.format_string("%.1f", F.col("confidence_pct")).alias("confidence"),
        F.col("language"),
        status_label().alias("status"),
    )


def export_totals(results: DataFrame) -> DataFrame:
    """Totals row of an export: count of names and average confidence."""
    return results.agg(
        F.count("filename").cast("bigint").alias("n_files"),
        F.round(F.avg("confidence_pct"), 2).alias("avg_confidence"),
    )


def write_export_csv(rows: DataFrame, path: str, web: bool = True) -> None:
    """CSV export with the display header."""
    header = O.EXPORT_HEADER_WEB if web else O.EXPORT_HEADER_DESKTOP
    cols = ["file", "new_name", "category", "confidence", "language", "status"] if web else \
        ["file", "category", "confidence", "status"]
    rows.select(*[F.col(c).alias(h) for c, h in zip(cols, header)]).write.mode("overwrite").csv(path, header=True)
