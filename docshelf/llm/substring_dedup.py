"""Substring dedup on sliding sentence spans (DataFrame operations only).

A text is cut into sentences (ends: a full stop before white space, ``!`` or ``?`` before white space and
anything but a lower-case letter, and line breaks, each with the white space after them), so that the
sentences joined give the text back.
Every run of ``run`` consecutive sentences with at least ``least_words`` words is a span, and so is every
shortest run of fewer sentences with at least ``long_words`` words. With ``lengthen``, as the query runs it,
a run of ``run`` sentences with too few words goes on until it has ``least_words``, and in scripts without
spaces between words lengths count in characters: two of Chinese or Japanese and four of Thai, Lao, Khmer or
Myanmar count as a word. Spans are hashed over their words in lower case. Equal spans are found by one global aggregation; of each, the first (smallest id, then row,
then place) stays, and the sentences that any other one covers go.

Defined results: null text counts as empty; a null id comes after all others; rows that repeat an id
are rows of their own; within one text too only the first of equal spans stays. Only the id and text
columns are read; they are written once with a key for each row, and every later scan reads that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import split_lookup
from ..session import drop_written
from .common import text_rows, written


@dataclass(frozen=True)
class SpanOptions:
    run: int = 3               # sentences in a span
    least_words: int = 12      # words in a span at least
    long_words: int = 25       # fewer sentences count from so many words on
    lengthen: bool = False     # runs of short sentences are lengthened, scripts without spaces count in characters


# Fixed value: a sentence with its end and the white space after it; one lazy run, so linear.
SENTENCE = r"(?s).+?(?:\.\s+|[!?]\s+(?=\P{Ll})|\n\s*|\z)"
# Fixed value: what counts as a word: a run of other signs, or some characters of a script without spaces.
_IDEOGRAPHS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{3001}-\x{303F}"
_UNSPACED = r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[{_IDEOGRAPHS}]{{1,2}}|[{_UNSPACED}]{{1,4}}|[^\s{_IDEOGRAPHS}{_UNSPACED}]+"


def with_sentences(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sentences", F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)))


def spans_of(rows: DataFrame, opts: SpanOptions) -> DataFrame:
    """``row_key, doc_id, at, length, h1, h2``: the hashed spans of each text."""
    def unspaced(s):        # ASCII texts, and those without signs from Thai on, are not read again
        return (F.octet_length(s) > F.char_length(s)) & s.rlike(r"[^\x{0}-\x{DFF}]") & F.lit(opts.lengthen)

    words = F.transform("sentences", lambda s: F.struct(
        F.regexp_extract_all(F.lower(s), F.lit(r"\S+"), F.lit(0)).alias("w"),
        F.when(unspaced(s), F.regexp_count(s, F.lit(WORD))).alias("n")))
    marks = (with_sentences(rows).select("row_key", "doc_id", words.alias("words"))
             .select("row_key", "doc_id", F.transform("words", lambda x: F.struct(
                 F.xxhash64(x["w"]).alias("h"), F.hash(x["w"]).alias("g"), F.coalesce(x["n"], F.size(x["w"])).alias("n"))).alias("s")))

    def total(part):
        return sum((x["n"] for x in part), F.lit(0))        # null for a run past the end

    def span(part, i):
        return F.struct(i.alias("at"), F.lit(len(part)).alias("length"),
                        F.xxhash64(*[x["h"] for x in part]).alias("h1"), F.hash(*[x["g"] for x in part]).alias("h2"))

    # only the first and the last sentence of a text can be without words, so no run needs more sentences
    most = max(opts.run, opts.least_words + 1) if opts.lengthen else opts.run

    def first_run(lengths, least: int):
        def one(first, i):
            part, out = [first] + [F.get(F.col("s"), i + k) for k in range(1, max(lengths))], F
            for n in lengths:           # of ordinary sentences, the first length is taken and no other looked at
                out = out.when(total(part[:n]) >= least, span(part[:n], i))
            return out
        return F.transform("s", one)

    all_runs = F.concat(first_run(range(opts.run, most + 1), opts.least_words),
                        *([first_run(range(1, opts.run), opts.long_words)] if opts.run > 1 else []))
    return (marks.select("row_key", "doc_id", F.explode(F.filter(all_runs, lambda x: x.isNotNull())).alias("x"))
            .select("row_key", "doc_id", "x.*"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   opts: SpanOptions = SpanOptions()) -> DataFrame:
    """One row per document: ``doc_id, n_sentences, n_removed, first_ids, text`` (what stays).

    ``first_ids``: the documents that hold the first of the removed spans.
    """
    rows = written(text_rows(docs, id_col, text_col), "rows", "zstd")
    spans = written(spans_of(rows, opts), "spans", "zstd")
    key = ["h1", "h2", "length"]
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "at")
    firsts = written(
        spans.groupBy(*key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(*key, "n", F.col("first.doc_id").alias("first_id"), F.col("first.row_key").alias("first_row"),
                F.col("first.at").alias("first_at")), "firsts", "zstd")
    repeated = (split_lookup(spans.drop("doc_id"), firsts, key, "n")      # a very common line is not one task
                .where((F.col("row_key") != F.col("first_row")) | (F.col("at") != F.col("first_at")))
                .groupBy("row_key")       # at most the spans of one text
                .agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("length") - 1)))).alias("gone"),
                     F.array_sort(F.collect_set("first_id")).alias("first_ids")))
    again = written(repeated, "repeats", "zstd")
    drop_written(spans)
    drop_written(firsts)
    stay = F.array_except(F.sequence(F.lit(0), F.size("sentences") - 1), "gone")       # by hash, in order
    kept = F.transform(stay, lambda i: F.get("sentences", i))
    none = F.col("gone").isNull()
    return (rows.join(again, "row_key", "left").transform(with_sentences)
            .select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
                    F.coalesce("first_ids", F.expr(f"cast(array() as array<{rows.schema['doc_id'].dataType.simpleString()}>)"))
                    .alias("first_ids"),
                    F.when(none, F.col("text")).otherwise(F.array_join(kept, "")).alias("text")))
