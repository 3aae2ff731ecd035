"""Joins that stay balanced when one key holds a large share of the rows.

A lookup join attaches per-key values (one row per key on the small side) to
a large table. If one key covers a third of the large table, a plain hash
join sends that third to one task. ``salted_lookup`` gives every large-side
row a deterministic salt in ``[0, buckets)`` and replicates the per-key side
once per salt, so a hot key is spread over ``buckets`` tasks. The per-key side
grows by ``buckets`` times, which is why it is meant for lookups whose other
side is much larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def salt_of(*cols: str | Column, buckets: int) -> Column:
    """Deterministic salt (stable across task retries; never ``rand()``)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.pmod(F.xxhash64(*cs), F.lit(buckets)).cast("int")


def salted_lookup(big: DataFrame, lookup: DataFrame, keys: list[str], salt_cols: list[str],
                  buckets: int, how: str = "inner") -> DataFrame:
    """``big`` joined to ``lookup`` on ``keys`` with hot keys spread over ``buckets`` tasks.

    ``salt_cols`` identify rows of ``big`` (e.g. a document id); ``how`` is
    ``inner`` or ``left`` (rows of ``big`` without a match are kept).
    """
    if buckets <= 1:
        return big.join(lookup, keys, how)
    b = big.withColumn(SALT, salt_of(*salt_cols, buckets=buckets))
    l = lookup.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(l, [*keys, SALT], how).drop(SALT)


# Keys that are joined by broadcast in split_lookup. A key that is not among them holds less than
# this fraction of the rows, about what one of as many shuffle partitions holds anyway.
HOT_KEYS = 10_000


def split_lookup(big: DataFrame, lookup: DataFrame, keys: list[str], rows_col: str,
                 hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``big`` with ``lookup`` in which hot keys are broadcast and the others shuffled.

    ``lookup`` has one row per key and in ``rows_col`` how many rows of ``big`` have it. A key is hot when
    it holds at least one of ``hot_keys`` equal shares of all rows, so there are never more than
    ``hot_keys`` of them: the broadcast side has a bound that does not grow with the data. Rows of hot
    keys stay where they are; nothing is replicated. The result is the same for any ``hot_keys``. Both
    sides are read twice, so they should be written tables. Null keys match nothing.
    """
    total = lookup.agg(F.sum(rows_col).cast("double")).first()[0] or 0.0
    is_hot = F.col(rows_col) * F.lit(float(hot_keys)) >= F.lit(total)
    hot = lookup.where(is_hot)
    cold = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return big.join(F.broadcast(hot), keys).unionByName(cold.join(lookup.where(~is_hot), keys))


# Largest lookup side (optimizer estimate, bytes) that is broadcast instead of
# salted. Estimates are exact for materialized Parquet and upper bounds for
# computed plans, so a computed side of unknown size takes the salted path.
# The driver holds about ten times the Parquet size while it builds the hash table.
BROADCAST_LIMIT = 8 * 1024 * 1024


# What narrow_join broadcasts at most: the size of a file says little about rows that repeat.
NARROW_LIMIT = 32 * 1024 * 1024
NARROW_ROWS = 4_000_000


def narrow_join(wide: DataFrame, narrow: DataFrame, on: list[str] | Column, how: str = "inner",
                broadcast_limit: int = NARROW_LIMIT) -> DataFrame:
    """``wide`` (rows with texts) joined to a ``narrow`` table of ids, which is broadcast while it is small.

    The texts then stay where they are; a shuffled join would write and sort them all, once for each read of the
    result. Beyond the limits both sides are shuffled. ``narrow`` should be a written table or a scan, whose size is known.
    """
    from ..session import estimated_bytes

    if estimated_bytes(narrow) <= broadcast_limit and narrow.count() <= NARROW_ROWS:
        narrow = F.broadcast(narrow)
    return wide.join(narrow, on, how)


def lookup_join(big: DataFrame, lookup: DataFrame, keys: list[str], salt_cols: list[str],
                buckets: int, how: str = "inner", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast ``lookup`` when its measured size is under the limit, else a salted shuffle join.

    A broadcast join keeps ``big`` where it is (no shuffle, no skew); beyond
    the limit the salted join spreads hot keys over ``buckets`` tasks.
    """
    from ..session import estimated_bytes

    if estimated_bytes(lookup) <= broadcast_limit:
        return big.join(F.broadcast(lookup), keys, how)
    return salted_lookup(big, lookup, keys, salt_cols, buckets, how)
