"""Rename proposals and destination plans.

Destination names follow the sequential rule: a file moved into a folder
keeps its name when it is free, otherwise it takes ``stem_1``, ``stem_2``, ...
(first free), where "taken" covers files already in the folder and files
planned before it.

The rule is resolved for all names at once. Call a request that does not get
its own name an *overflow*. Since taken numbers are never given back, the
overflows of a name take free numbers in rising order: the j-th overflow takes
the j-th number that is not *skipped*. A number is skipped when it exists
already, or when a request for that very name came before the overflow that
would have reached it. So

* every request gets its rank among the requests for its name (distributed
  ordinal), and j is that rank, less one if the first request keeps the name;
* a numbered name requested explicitly gets the count of requests for its
  parent name before it (distributed running count); whether it is skipped
  follows from that count and the numbers skipped below it. Names are settled from fewer to more
  numbered tails, because an overflow of ``a`` may take ``a_1`` from the requests for ``a_1``;
* skipped numbers become thresholds, and the number of the j-th overflow is j plus the
  thresholds up to j (distributed running count).

Requests of a hot name or family are thus many tasks' work. Only the explicitly numbered names
below one name pass through one task, as two integers each, streamed in order. Numbers are canonical:
no leading zero, at most 18 digits. A name that ends in a dot and a numbered tail (``a._1``) counts as a numbered form of ``a.``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordinal import with_group_row_number, with_group_running_count
from ..functions.text import base_name, sanitise_name, stem, stripped_length_at_least, suffix
from ..options import RENAME_MIN_CHARS, RESTORED_SUFFIX
from ..session import materialize
from .skew import lookup_join


def proposed_name(original: str, text: str, raw: str, enabled: bool = True):
    """New file name (F2): sanitised proposal + original suffix, or the original.

    Kept when renaming is disabled, the stripped text is shorter than 20
    characters, there is no proposal, or the sanitised proposal is empty.
    """
    return proposed_name_if(F.lit(enabled) & stripped_length_at_least(text, RENAME_MIN_CHARS), original, raw)


def proposed_name_if(long_enough: Column, original: str, raw: str) -> Column:
    """:func:`proposed_name` where the length of the text was looked at before."""
    o = F.col(original)
    clean = sanitise_name(F.col(raw))
    ok = long_enough & F.col(raw).isNotNull() & (F.length(clean) > 0)
    return F.when(ok, F.concat(clean, suffix(o))).otherwise(o)


def _numbered(df: DataFrame, name_col: str, sep: str) -> DataFrame:
    """Adds ``_parent`` (the name this one is a numbered form of), ``_number`` and ``_depth`` (numbered tails)."""
    n, tail = F.col(name_col), re.escape(sep) + "[1-9][0-9]{0,17}"
    dotted = F.regexp_extract(n, rf"(?s)^(.+\.){tail}\z", 1)
    tails = F.regexp_extract(F.col("_stem"), rf"((?:{tail})+)\z", 1)
    last = F.substring_index(F.when(F.col("_dotted") != "", n).otherwise(F.col("_stem")), sep, -1)
    cut = lambda c: c.substr(F.lit(1), F.length(c) - F.length("_last") - len(sep))
    parent = F.concat(cut(F.col("_stem")), suffix(n))
    return (
        df.withColumn("_stem", stem(n)).withColumn("_dotted", dotted).withColumn("_tails", tails)
        .withColumn("_depth", F.when(F.col("_dotted") != "", 1).when(F.col("_tails") == "", 0)
                    .otherwise((F.length("_tails") - F.length(F.replace("_tails", F.lit(sep), F.lit("")))) / len(sep)).cast("int"))
        .withColumn("_last", F.when(F.col("_depth") > 0, last))
        .withColumn("_number", F.col("_last").cast("bigint"))
        .withColumn("_parent", F.when(F.col("_dotted") != "", F.col("_dotted"))
                    .when((F.col("_depth") > 0) & (suffix(parent) == suffix(n)), parent))
        .drop("_stem", "_dotted", "_tails", "_last"))


def _skipped(level: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _number, _child, _skip`` for ``level(keys, _number, _child, _before, _keeps)``.

    ``_before``: requests for the name before the number was asked for (0 where it exists); ``_keeps``: the
    first request keeps the name. The numbers of a name are streamed in order.
    """
    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, skipped = None, 0
        for b in batches:
            flags = []
            for d, name, number, before, keeps in zip(b[keys[0]], b[keys[1]], b["_number"], b["_before"], b["_keeps"]):
                if (d, name) != at:
                    at, skipped = (d, name), 0
                skip = number - skipped > max(before - keeps, 0)
                skipped += skip
                flags.append(bool(skip))
            yield b[[*keys, "_number", "_child"]].assign(_skip=flags)

    return (level.select(*keys, "_number", "_child", "_before", "_keeps").repartition(*keys)
            .sortWithinPartitions(*keys, "_number")
            .mapInPandas(stream, f"{keys[0]} string, {keys[1]} string, _number bigint, _child string, _skip boolean"))


def _settle(ranked: DataFrame, names: DataFrame, held: DataFrame | None, keys: list[str],
            order: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Names whose requests all overflow because an overflow of their parent took them, and skipped numbers.

    Returns ``taken(keys)`` and ``skips(keys, _number)``; None stands for none.
    """
    d, name = keys
    free = "NOT _exists"
    asked = names.where(f"_parent IS NOT NULL AND {free}").select(d, F.col("_parent").alias(name), "_number", F.col(name).alias("_child"))
    parents = names.select(d, name, "_n", "_exists", "_depth")
    links = None if asked.isEmpty() else materialize(asked.join(parents, keys), "name-links")
    statics = None if held is None else held.where("_parent IS NOT NULL").select(d, F.col("_parent").alias(name), "_number") \
        .join(parents.select(*keys), keys, "left_semi")
    if links is None or links.isEmpty():
        return None, statics

    # requests for a name before the first request for each of its numbered forms
    first = ranked.where("_k = 1").select(d, F.col(name).alias("_child"), *order)
    marks = links.select(d, name, "_number", "_child").join(first, [d, "_child"])
    asking = ranked.join(links.select(*keys).distinct(), keys, "left_semi").select(*keys, *order)
    events = asking.withColumn("_asks", F.lit(True)).unionByName(marks.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    counted = materialize(
        with_group_running_count(events, keys, [F.col(c) for c in order], "_asks", "_before").where("NOT _asks")
        .select(*keys, "_number", "_child", "_before").join(parents, keys), "name-counts")
    fixed = None
    if statics is not None:
        fixed = statics.join(counted.select(*keys).distinct(), keys, "left_semi").select(
            *keys, "_number", F.lit(None).cast("string").alias("_child"), F.lit(0).cast("bigint").alias("_before"))
        fixed = materialize(fixed.join(parents, keys), "name-fixed")
    taken, settled = None, []
    for r in sorted(x._depth for x in counted.select("_depth").distinct().collect()):      # one row per depth
        level = counted.where(F.col("_depth") == r)
        if fixed is not None:
            level = level.unionByName(fixed.where(F.col("_depth") == r))
        keeps = ~F.col("_exists")
        if taken is not None:
            level = level.join(taken.withColumn("_gone", F.lit(True)), keys, "left")
            keeps = keeps & F.col("_gone").isNull()
        done = materialize(_skipped(level.withColumn("_keeps", keeps.cast("int")), keys), "name-skips")
        settled.append(done.where("_skip").select(*keys, "_number"))
        now = done.where("NOT _skip AND _child IS NOT NULL").select(d, F.col("_child").alias(name))
        taken = now if taken is None else taken.unionByName(now)
    skips = settled[0]
    for more in settled[1:]:
        skips = skips.unionByName(more)
    if statics is not None:
        skips = skips.unionByName(statics.join(counted.select(*keys).distinct(), keys, "left_anti"))
    return taken, skips


def plan_names(requests: DataFrame, existing: DataFrame | None, dir_col: str = "dest_dir",
               name_col: str = "name", order_cols: list[str] | None = None, sep: str = "_") -> DataFrame:
    """Add ``final_name`` to ``requests(dir_col, name_col, *order_cols, ...)``.

    ``existing(dir_col, name_col)`` lists names already present in the folders. ``order_cols`` give the
    sequential order of the requests (nulls first); requests of equal order follow each other in some order.
    A null name or folder stays without a final name.
    """
    keys, order = [dir_col, name_col], [*(order_cols or []), "_rid"]
    known = requests.where(F.col(dir_col).isNotNull() & F.col(name_col).isNotNull())
    # written once, in order: from here on rows keep their id
    ranked = with_group_row_number(known.withColumn("_rid", F.monotonically_increasing_id()), keys,
                                   [F.col(c) for c in order], "_k")
    names = _numbered(ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), name_col, sep)
    held = None
    if existing is not None:
        held = materialize(_numbered(existing.select(*keys).distinct(), name_col, sep), "names-held")
        names = names.join(held.select(*keys, F.lit(True).alias("_exists")), keys, "left") \
            .withColumn("_exists", F.coalesce("_exists", F.lit(False)))
    else:
        names = names.withColumn("_exists", F.lit(False))
    names = materialize(names, "names")
    taken, skips = _settle(ranked, names, held, keys, order)

    gone = names.where("_exists").select(*keys)
    if taken is not None:
        gone = gone.unionByName(taken)
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if held is None and taken is None:
        req = ranked.withColumn("_gone", F.lit(None).cast("boolean"))
    else:
        req = lookup_join(ranked, materialize(gone.distinct(), "names-gone").withColumn("_gone", F.lit(True)), keys, ["_rid"], min(parts, 16), "left")
    req = req.withColumn("_j", F.col("_k") - F.when(F.col("_gone").isNull(), 1).otherwise(0))
    number, out = F.col("_j"), [*requests.columns, "final_name"]
    made = F.concat(stem(F.col(name_col)), F.lit(sep), F.col("_take").cast("string"), suffix(F.col(name_col)))
    final = F.when(F.col("_j") == 0, F.col(name_col)).otherwise(made)
    lost = requests.where(F.col(dir_col).isNull() | F.col(name_col).isNull()).withColumn("final_name", F.lit(None).cast("string"))
    if skips is None:
        return req.withColumn("_take", number).withColumn("final_name", final).select(*out).unionByName(lost.select(*out))

    # the i-th skipped number (from 0) moves every overflow from number - i on by one
    skips = with_group_row_number(skips, keys, [F.col("_number")], "_i") \
        .select(*keys, (F.col("_number") - F.col("_i") + 1).alias("_j"), F.lit(True).alias("_moves"))
    moved = materialize(skips, "name-thresholds")
    with_skips = materialize(moved.select(*keys).distinct().withColumn("_skips", F.lit(True)), "names-skipping")
    req = materialize(lookup_join(req, with_skips, keys, ["_rid"], min(parts, 16), "left"), "name-numbers")
    plain = req.where("_skips IS NULL").withColumn("_take", number).withColumn("final_name", final)
    events = req.where("_skips").withColumn("_moves", F.lit(False)).unionByName(moved, allowMissingColumns=True)
    counted = with_group_running_count(events, keys, [F.col("_j"), F.desc("_moves")], "_moves", "_past") \
        .where("NOT _moves").withColumn("_take", number + F.col("_past")).withColumn("final_name", final)
    return plain.select(*out).unionByName(counted.select(*out)).unionByName(lost.select(*out))


def destination_plan(files: DataFrame, root: str, category_col: str = "category", name_col: str = "name",
                     order_cols: list[str] | None = None, existing: DataFrame | None = None,
                     dry_run: bool = False) -> DataFrame:
    """``dest_path`` = ``<root>/<category>/<final name>`` (F3); dry run keeps the name."""
    root = root.rstrip("/")
    with_dir = files.withColumn("dest_dir", F.concat(F.lit(root + "/"), F.col(category_col)))
    if dry_run:
        return with_dir.withColumn("dest_path", F.concat(F.col("dest_dir"), F.lit("/"), F.col(name_col))).drop("dest_dir")
    planned = plan_names(with_dir, existing, "dest_dir", name_col, order_cols)
    return planned.withColumn("dest_path", F.concat(F.col("dest_dir"), F.lit("/"), F.col("final_name"))) \
        .drop("dest_dir", "final_name")


def restore_plan(moves: DataFrame, occupied: DataFrame, order_cols: list[str]) -> DataFrame:
    """Restore targets (H6): the source path, or ``stem_restored_N`` when occupied.

    ``moves(source_path, ...)``; ``occupied(path)`` lists paths that exist now.
    """
    req = moves.withColumn("_dir", F.regexp_extract("source_path", r"^(.*)/[^/]*$", 1)) \
        .withColumn("_name", base_name("source_path"))
    ex = occupied.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("_dir"), base_name("path").alias("_name"))
    planned = plan_names(req, ex, "_dir", "_name", order_cols, sep=RESTORED_SUFFIX)
    return planned.withColumn("restore_path", F.concat(F.col("_dir"), F.lit("/"), F.col("final_name"))) \
        .drop("_dir", "_name", "final_name")
