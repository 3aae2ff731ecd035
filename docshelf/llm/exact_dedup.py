"""Exact dedup by a tree merge of sorted digest runs (DataFrame operations only).

Every input split is a run. A run holds one entry per distinct text: its digest, the row that
would stay, and a count. In each round, ``fan_in`` neighbouring runs exchange their entries and
are merged into one sorted run, until one run covers the table: about log(splits) rounds. The
decisions then go back down the same tree, so an entry is only ever joined with the at most
``fan_in`` entries it was merged from, and a row only with the entry of its own split. A text
that holds a third of all rows is thus never one task's work, on the way up or down.

A digest entry is the SHA-256 of the UTF-8 bytes, verified by the byte length and an independent
64-bit hash: rows agree only if all three do.

Defined results: null text counts as empty; a null id is the smallest; of rows that repeat both id
and text exactly one stays; an empty table gives an empty result. Only the id and text columns are
read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, whole_text, written

FAN_IN = 16
DIGEST = ["digest", "n_bytes", "check"]


def digest_leaves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per input row: its run (input split), its key in the run, id and digest."""
    return docs.select(
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row_key"),
        F.col(id_col).alias("doc_id"),
        whole_text(text_col).alias("text"),
    ).select("run", "row_key", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"),
             F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("check"))


def _best(keep: str):
    order = F.struct("null_rank", "doc_id", "row_key")
    return (F.max(order) if keep == "max" else F.min(order)).alias("best")


def _merge(entries: DataFrame, keep: str) -> DataFrame:
    """Entries of the same run and digest become one: the best row and the summed count."""
    return (entries.groupBy("run", *DIGEST).agg(_best(keep), F.sum("n").alias("n"))
            .select("run", *DIGEST, "best.null_rank", "best.doc_id", "best.row_key", "n")
            .sortWithinPartitions("run", "digest"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                 fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` says whether the largest (``max``) or smallest (``min``) id of equal texts stays.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    leaves = written(digest_leaves(docs, id_col, text_col), "digest-leaves")
    null_rank = F.col("doc_id").isNull() if keep == "min" else F.col("doc_id").isNotNull()
    level = written(_merge(leaves.select("run", *DIGEST, null_rank.alias("null_rank"), "doc_id", "row_key",
                                         F.lit(1).cast("bigint").alias("n")), keep), "digest-run")
    levels, runs = [level], (leaves.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        up = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        level = written(_merge(up, keep), "digest-run")
        levels.append(level)
        runs = -(-runs // fan_in)

    # back down: only texts with copies travel
    decided = levels[-1].where("n > 1").select(
        "run", *DIGEST, F.col("doc_id").alias("win_id"), F.col("row_key").alias("win_key"), F.col("n").alias("size"))
    for below in reversed(levels[:-1]):
        child = below.select("run", *DIGEST, F.floor(F.col("run") / fan_in).cast("int").alias("parent"))
        decided = (child.join(decided.withColumnRenamed("run", "parent"), ["parent", *DIGEST])
                   .select("run", *DIGEST, "win_id", "win_key", "size"))
    out = leaves.join(decided, ["run", *DIGEST], "left")
    single = F.col("size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("win_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("bigint")).alias("group_size"),
        (single | (F.col("row_key") == F.col("win_key"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without the rows that an equal text makes redundant, all columns unchanged.

    Rows are matched by id and digest. Where id and text both repeat, the row whose other
    columns sort first stays.
    """
    from pyspark.sql import Window

    key, place = free_name(docs, "__key"), free_name(docs, "__n")
    of = lambda doc_id, digest: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), digest).alias(key)
    kept = exact_groups(docs, id_col, text_col, keep).where("kept").select(of(F.col("doc_id"), F.col("text_sha256")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*columns, of(F.col(f"`{id_col}`"), F.sha2(whole_text(text_col), 256)))
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in (id_col, text_col)]
    first = Window.partitionBy(key).orderBy(*(others or [F.lit(0)]))
    return (keyed.join(kept, key, "left_semi").withColumn(place, F.row_number().over(first))
            .where(F.col(place) == 1).select(*columns))
