"""Exact-duplicate detection by content hash.

The first file (lowest scan order) with a given hash is the original; later
files with that hash are its duplicates; a null hash is never a duplicate.

Scale notes: one hash may be shared by a third of all files (a template
copied everywhere). Nothing here groups all rows of one hash into one task:
per-hash facts come from a partially aggregated ``groupBy`` (map-side
combine), and they are attached back with a salted join
(:mod:`.skew`). The "keep originals" filter joins on ``(hash, order)``,
which is unique, so it needs no salt at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import salted_lookup

DEFAULT_SALT = 16


def with_content_hash(df: DataFrame, source_col: str = "text", out: str = "content_hash") -> DataFrame:
    """MD5 hex of the content (strings are hashed as their UTF-8 bytes)."""
    return df.withColumn(out, F.md5(F.col(source_col).cast("binary")))


def first_per_hash(df: DataFrame, hash_col: str = "content_hash", order_col: str = "doc_id",
                   path_col: str = "path") -> DataFrame:
    """``(hash, first_order, original_path, n_copies)``, one row per non-null hash."""
    return (
        df.where(F.col(hash_col).isNotNull())
        .groupBy(hash_col)
        .agg(F.min(F.struct(F.col(order_col).alias("o"), F.col(path_col).alias("p"))).alias("_first"),
             F.count(F.lit(1)).alias("n_copies"))
        .select(hash_col, F.col("_first.o").alias("first_order"), F.col("_first.p").alias("original_path"),
                "n_copies")
    )


def mark_duplicates(df: DataFrame, hash_col: str = "content_hash", order_col: str = "doc_id",
                    path_col: str = "path", salt_buckets: int = DEFAULT_SALT) -> DataFrame:
    """Add ``is_duplicate`` and ``original_path`` (null unless a duplicate)."""
    # a hash seen once is never a duplicate: only the others travel, and only they are replicated
    firsts = first_per_hash(df, hash_col, order_col, path_col).where("n_copies > 1").drop("n_copies")
    joined = salted_lookup(df, firsts, [hash_col], [order_col], salt_buckets, how="left")
    is_dup = F.coalesce(F.col(order_col) != F.col("first_order"), F.lit(False))
    return (
        joined.withColumn("is_duplicate", is_dup)
        .withColumn("original_path", F.when(is_dup, F.col("original_path")))
        .drop("first_order")
    )


def keep_originals(df: DataFrame, hash_col: str = "content_hash", order_col: str = "doc_id",
                   path_col: str = "path") -> DataFrame:
    """Rows that are not duplicates (C6): originals and rows with a null hash."""
    firsts = (
        df.where(F.col(hash_col).isNotNull())
        .groupBy(hash_col).agg(F.min(order_col).alias(order_col))
    )
    originals = df.join(firsts, [hash_col, order_col], "left_semi")
    return originals.unionByName(df.where(F.col(hash_col).isNull()))


def duplicate_groups(df: DataFrame, hash_col: str = "content_hash", order_col: str = "doc_id",
                     path_col: str = "path", salt_buckets: int = DEFAULT_SALT) -> DataFrame:
    """Members of every hash group with more than one file, one row per member.

    Columns: hash, order, path, n_copies, original_path, is_original. Groups
    stay as rows (a group may be huge); ``orderBy(hash, order)`` gives the
    seen order and is a range-partitioned sort, not a per-group collect.
    """
    stats = first_per_hash(df, hash_col, order_col, path_col).where(F.col("n_copies") > 1)
    members = salted_lookup(df.select(hash_col, order_col, path_col), stats, [hash_col], [order_col],
                            salt_buckets, how="inner")
    return members.select(
        hash_col, order_col, path_col, "n_copies", "original_path",
        (F.col(order_col) == F.col("first_order")).alias("is_original"),
    )


def check_against_registry(batch: DataFrame, registry: DataFrame, hash_col: str = "content_hash",
                           order_col: str = "doc_id", path_col: str = "path",
                           salt_buckets: int = DEFAULT_SALT) -> DataFrame:
    """Duplicates of a batch against hashes seen earlier (C4).

    ``registry(hash_col, first_path)`` holds hashes known from earlier runs.
    A batch file is a duplicate when its hash is registered or when an earlier
    file of the same batch has it; ``original_path`` is the registered path
    first, else the first path in the batch.
    """
    marked = mark_duplicates(batch, hash_col, order_col, path_col, salt_buckets)
    # of the registry only the batch's hashes are replicated
    present = batch.where(F.col(hash_col).isNotNull()).select(hash_col).distinct()
    reg = registry.select(hash_col, F.col("first_path").alias("_reg_path")).join(present, [hash_col], "left_semi")
    joined = salted_lookup(marked, reg, [hash_col], [order_col], salt_buckets, how="left")
    known = F.col("_reg_path").isNotNull()
    return (
        joined.withColumn("original_path", F.when(known, F.col("_reg_path")).otherwise(F.col("original_path")))
        .withColumn("is_duplicate", known | F.col("is_duplicate"))
        .drop("_reg_path")
    )


def update_registry(registry: DataFrame, batch: DataFrame, hash_col: str = "content_hash",
                    order_col: str = "doc_id", path_col: str = "path") -> DataFrame:
    """Registry after a batch: earlier entries win, new hashes add their first path."""
    new = (
        first_per_hash(batch, hash_col, order_col, path_col)
        .select(hash_col, F.col("original_path").alias("first_path"))
        .join(registry.select(hash_col), [hash_col], "left_anti")
    )
    return registry.select(hash_col, "first_path").unionByName(new)


def empty_registry(spark, hash_col: str = "content_hash") -> DataFrame:
    """Reset (C5): a registry with no hashes."""
    return spark.createDataFrame([], f"{hash_col} string, first_path string")
