"""Reading the input tables.

``read_table`` is a plain Parquet scan (filters and column pruning reach the
scan). Text-heavy tables get one extra rule: when a table's scan has fewer
splits than the session has cores, its rows are spread round-robin so per-row
work (regex, tokenising) uses every core. On a cluster reading many files the
rule never fires and the scan's own splits are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Tables whose rows carry long text or vectors: per-row cost dominates.
HEAVY_ROW_TABLES = {"documents", "pages", "conversations", "embeddings", "benchmark"}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def spread_rows(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cores when the scan has fewer splits than cores.

    Only the split count is asked for (planning, no job, no file list on the
    driver); a large table has far more splits than cores and is left as is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    if spread is None:
        spread = name in HEAVY_ROW_TABLES
    return spread_rows(df) if spread else df


def file_path_col(doc_id: str = "doc_id", source: str = "source") -> Column:
    """Path a document stands for: ``<source>/<doc_id>.txt``."""
    return F.concat(F.col(source), F.lit("/"), F.col(doc_id).cast("string"), F.lit(".txt"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """``documents`` seen as files: ``doc_id, path, filename, category(lang), text``."""
    return docs.select(
        "doc_id",
        file_path_col().alias("path"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("lang").alias("category"),
        "text",
    )
