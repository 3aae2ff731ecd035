"""Compose one text per file from ordered parts (B2, B2a-B2g).

Every multi-part format reduces to: ordered parts -> keep some -> cap the
count -> cut each -> join with a separator. Parts arrive as rows
``(path, kind, seq, text)``; the parts of one file make one text, so they meet
in one row. Nothing is left out unless the caller caps the rule.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


@dataclass(frozen=True)
class Rule:
    sep: str = "\n"
    keep: str = "nonblank"          # nonblank | nonempty | notnull | all
    trim: bool = False              # strip each part before joining
    max_parts: int | None = None    # keep the first N kept parts
    max_chars: int | None = None    # cut each part


# Presets per source format; none leaves anything out
ARCHIVE = Rule(sep="\n", keep="all")                         # archive members
PARAGRAPHS = Rule(sep="\n", keep="nonblank")                 # word-processor paragraphs, untrimmed
CELLS = Rule(sep=" ", keep="notnull")                        # spreadsheet cells
SLIDES = Rule(sep="\n", keep="nonblank", trim=True)          # slide paragraphs, trimmed
PAGES = Rule(sep="\n", keep="nonempty")                      # page texts
MESSAGE = Rule(sep="\n", keep="nonempty")                    # subject, sender, body when present
MAIL = Rule(sep="\n", keep="nonempty")                       # subject, from, text parts


def capped(rule: Rule, max_parts: int | None, max_chars: int | None) -> Rule:
    """``rule`` limited to the first parts and characters (what is left out is counted)."""
    return replace(rule, max_parts=max_parts, max_chars=max_chars)


def _keep_pred(rule: Rule) -> Column:
    t = F.col("text")
    if rule.keep == "nonblank":
        return t.isNotNull() & t.rlike(r"[^\s\p{Z}]")
    if rule.keep == "nonempty":
        return t.isNotNull() & (t != "")
    if rule.keep == "notnull":
        return t.isNotNull()
    return F.lit(True)


def compose(parts: DataFrame, rule: Rule, file_col: str = "path") -> DataFrame:
    """``(file_col, text, parts_left_out, chars_left_out)``: one composed text per file that has parts.

    Only a capped rule leaves parts or characters out; the characters are those of the kept parts.
    """
    kept = parts.where(_keep_pred(rule)).withColumn("text", strip("text") if rule.trim else F.col("text"))
    kept = kept.withColumn("_cut", F.lit(0))
    if rule.max_chars is not None:
        kept = kept.withColumn("_cut", F.greatest(F.lit(0), F.length("text") - rule.max_chars)) \
            .withColumn("text", F.substring("text", 1, rule.max_chars))
    left_out = F.lit(0).cast("bigint")
    if rule.max_parts is not None:
        counts = kept.groupBy(file_col).agg(F.count(F.lit(1)).alias("_all"))
        # a per-file limit: Spark thins each task's rows before the shuffle
        first = Window.partitionBy(file_col).orderBy("seq")
        kept = kept.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= rule.max_parts)
        kept = kept.join(counts.where(F.col("_all") > rule.max_parts), [file_col], "left")
        left_out = F.coalesce(F.max("_all") - rule.max_parts, F.lit(0)).cast("bigint")
    return (
        kept.groupBy(file_col)
        .agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_parts"),
             left_out.alias("parts_left_out"), F.sum("_cut").cast("bigint").alias("chars_left_out"))
        .select(file_col, F.array_join(F.transform("_parts", lambda p: p["text"]), rule.sep).alias("text"),
                "parts_left_out", "chars_left_out")
    )
