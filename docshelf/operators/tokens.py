"""Tokenising and term counting (D3).

Tokens: lower-cased runs of two or more letters, digits or underscores; stop
words removed; then n-grams over what is left. Term counts are computed
inside each document's row (Arrow columns of a few hundred documents at a
time) so the corpus is turned into ``(doc, term, tf)`` rows without a
shuffle; the first shuffle is the one by ``term`` that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.stopwords import token_stop_words
from ..functions.text import TOKEN_RE


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens(text: str | Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """Array of tokens after stop-word removal."""
    t = F.col(text) if isinstance(text, str) else text
    raw = F.regexp_extract_all(F.lower(t), F.lit(TOKEN_RE), 0)
    stop = token_stop_words(stop_words)
    if not stop:
        return raw
    # ``isin`` with many literals becomes a hash-set lookup (InSet).
    return F.filter(raw, lambda x: ~x.isin(*stop))


def ngrams(toks: Column, ngram_range: tuple[int, int]) -> Column:
    """All n-grams for n in the inclusive range, unigrams first, each in text order.

    ``toks`` must be a column reference (not an expression): it is read inside
    lambdas, and an expression there would be evaluated once per element.
    """
    lo, hi = ngram_range
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(toks)
        else:
            # zip the array with its shifted copies: gram i = t[i] .. t[i+n-1]
            shifted = [F.slice(toks, k + 1, F.greatest(F.size(toks) - k, F.lit(0))) for k in range(n)]
            grams = F.arrays_zip(*shifted)
            fields = [f"{k}" for k in range(n)]
            joined = F.transform(grams, lambda g: F.concat_ws(" ", *[g[f] for f in fields]))
            parts.append(F.slice(joined, 1, F.greatest(F.size(toks) - n + 1, F.lit(0))))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


# Documents whose grams are counted at once: what a task holds does not grow with its partition.
COUNT_ROWS = 256


def _term_counter(cols: list[str], ngram_range: tuple[int, int]):
    """Function for ``mapInArrow`` from ``(*cols, tokens)`` to ``(*cols, term, tf)``."""
    def grams(toks: pa.Array) -> pa.Table:
        flat, row = toks.flatten(), pc.list_parent_indices(toks).to_numpy()
        rows, terms = [row[:0]], [flat.slice(0, 0)]
        for n in range(ngram_range[0], ngram_range[1] + 1):
            m = max(len(flat) - n + 1, 0)
            inside = row[:m] == row[len(row) - m:]          # the n tokens from here on are of one row
            gram = flat if n == 1 else pc.binary_join_element_wise(*[flat.slice(k, m) for k in range(n)], pa.scalar(" ", flat.type))
            rows.append(row[:m][inside])
            terms.append(gram.filter(pa.array(inside)))
        return pa.table({"row": np.concatenate(rows), "term": pa.concat_arrays(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, COUNT_ROWS):
                b = whole.slice(at, COUNT_ROWS)
                counts = grams(b.column(len(cols))).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
                row = counts["row"].to_numpy()
                order = np.argsort(row, kind="stable")      # a document's terms stay together
                row, order = pa.array(row[order]), pa.array(order)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k).take(row) for k in range(len(cols))],
                     *[counts[c].combine_chunks().take(order) for c in ("term", "count_all")]], names=[*cols, "term", "tf"])

    return count


def doc_terms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              ngram_range: tuple[int, int] = (1, 2), stop_words: tuple[str, ...] | None = None,
              keep: list[str] | None = None) -> DataFrame:
    """``(id_col, *keep, term, tf)``: one row per distinct term of each document."""
    cols = [id_col, *(keep or [])]
    step = df.select(*cols, tokens(text_col, stop_words).alias("_tok"))
    kept = [StructField(f.name, f.dataType, True) for f in step.schema.fields[:-1]]
    return step.mapInArrow(_term_counter(cols, ngram_range),
                           StructType([*kept, StructField("term", StringType()), StructField("tf", LongType())]))


def doc_terms_shuffled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       ngram_range: tuple[int, int] = (1, 2), stop_words: tuple[str, ...] | None = None,
                       keep: list[str] | None = None) -> DataFrame:
    """Same rows as :func:`doc_terms` by explode + group by (partial aggregation, one shuffle)."""
    keep = list(keep or [])
    grams = ngrams(tokens(text_col, stop_words), ngram_range)
    return (
        df.select(id_col, *keep, F.explode(grams).alias("term"))
        .groupBy(id_col, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))
    )
