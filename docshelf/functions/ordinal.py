"""Global row numbers without funnelling rows through one task.

``Window.orderBy(...)`` without ``partitionBy`` moves every row to a single
partition. Here the rows are range-sorted in parallel, each partition counts
its rows, the (tiny) per-partition counts become offsets, and each row's
ordinal is its partition's offset plus its position inside the partition.
The sorted rows are written with their partition and position, so a lost
executor cannot change them between the two reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_LOCAL_MASK = (1 << 33) - 1


def with_row_number(df: DataFrame, order_cols: list, out: str = "row_no") -> DataFrame:
    """``df`` plus a 1-based ordinal in ``order_cols`` order (keys should be unique)."""
    sorted_df = materialize(
        df.orderBy(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id()), "ordinal")
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, safe to broadcast
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    )
    return (
        sorted_df.join(F.broadcast(offsets), ["_pid"], "left")
        .withColumn(out, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK)) + 1)
                    .cast("bigint"))
        .drop("_pid", "_mid", "_off")
    )


def with_group_row_number(df: DataFrame, group_cols: list[str], order_cols: list, out: str = "group_row_no") -> DataFrame:
    """``df`` plus a 1-based ordinal inside each group, in ``order_cols`` order.

    Same as ``row_number() over (partition by group order by ...)`` but a hot
    group is not sent to one task: rows are range-sorted by (group, order),
    so a large group spans several partitions; each (partition, group) pair
    reports its first local id and row count, and a group's offset in a
    partition is the count of its rows in earlier partitions. The
    (partition, group) table has at most partitions + groups rows.
    """
    sorted_df = materialize(
        df.repartitionByRange(*[F.col(c) for c in group_cols], *order_cols)
        .sortWithinPartitions(*[F.col(c) for c in group_cols], *order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id()), "group-ordinal")
    parts = sorted_df.groupBy("_pid", *group_cols).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_pid", *group_cols, "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        sorted_df.join(offsets, ["_pid", *group_cols], "left")
        .withColumn(out, (F.col("_off") + (F.col("_mid") - F.col("_first")) + 1).cast("bigint"))
        .drop("_pid", "_mid", "_first", "_off")
    )


def with_group_running_count(df: DataFrame, group_cols: list[str], order_cols: list, flag: str, out: str) -> DataFrame:
    """``df`` plus the number of rows flagged so far in its group, itself included, in ``order_cols`` order.

    Range-sorted like :func:`with_group_row_number`: counts inside a partition come from a window over
    (partition, group), so a hot group is as many tasks as it has partitions.
    """
    groups = [F.col(c) for c in group_cols]
    sorted_df = materialize(
        df.repartitionByRange(*groups, *order_cols).sortWithinPartitions(*groups, *order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id()), "group-count")
    one = F.when(F.col(flag), 1).otherwise(0).cast("bigint")
    totals = sorted_df.groupBy("_pid", *group_cols).agg(F.sum(one).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *group_cols, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid", *group_cols).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    return (sorted_df.withColumn("_in", F.sum(one).over(inside))
            .join(offsets, ["_pid", *group_cols], "left")
            .withColumn(out, F.col("_off") + F.col("_in")).drop("_pid", "_mid", "_off", "_in"))
