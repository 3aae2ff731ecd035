"""TF-IDF weights (D4): sublinear tf, smoothed idf, L2-normalised per document.

Spark ML's ``IDF`` has neither the ``+1`` smoothing term nor sublinear tf, so the weights are computed here.
Occurrences of terms are shuffled as blocks (:mod:`.term_blocks`), once for the norms of the documents and once
for the weights; a row per term of each document comes only after the last shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..session import materialize
from . import term_blocks as tb
from .skew import narrow_join

# Parts that the terms are dealt to: at least so many, and one per so many bytes of text, so that a part (which
# one task holds) does not grow with the data. A document has one row of sums per part at most.
LEAST_PARTS = 32
PART_TEXT_BYTES = 32 << 20


def part_count(text_bytes: int | None, part_bytes: int = PART_TEXT_BYTES) -> int:
    return max(LEAST_PARTS, (text_bytes or 0) // part_bytes)


def part_df(blocks: list[tb.Block], codes: list[np.ndarray], n_terms: int) -> np.ndarray:
    """Total weight of the samples that have each term of a part."""
    df = np.zeros(n_terms)
    for b, c in zip(blocks, codes):
        term, doc, _ = b.occurrences()
        df[c] += np.bincount(term, b.numbers("weight")[doc], len(c))       # a term is once in a block
    return df


def document_norms(samples: DataFrame, n: float, parts: int, ngram_range: tuple[int, int],
                   stop_words: tuple[str, ...] | None) -> DataFrame:
    """``sample_id, norm`` of ``samples(sample_id, weight, text)`` of total weight ``n``; samples of one id share a norm."""
    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in tb.whole_parts(batches):
            terms, codes = tb.dictionary(blocks)
            idf = np.log((1.0 + n) / (1.0 + part_df(blocks, codes, len(terms)))) + 1.0
            for b, c in zip(blocks, codes):
                term, doc, tf = b.occurrences()
                ids = b.kept("sample_id")
                q = np.bincount(doc, (tf * idf[c][term]) ** 2, len(ids))
                yield pa.RecordBatch.from_arrays([ids, pa.array(q)], names=["sample_id", "q"])

    packed = tb.term_blocks(samples, ["sample_id", "weight"], "text", parts, ngram_range, stop_words)
    schema = StructType([StructField("sample_id", samples.schema["sample_id"].dataType), StructField("q", DoubleType())])
    return tb.by_part(packed, parts).mapInArrow(squares, schema).groupBy("sample_id").agg(F.sqrt(F.sum("q")).alias("norm"))


def tfidf(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram_range=(1, 2),
          stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """``(id, term, tf, idf, weight)`` for every distinct term of every document; documents of one id share a norm.

    Eager as far as the norms, which are written; they then travel with the texts to the weights of their terms.
    """
    samples = df.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text"), F.lit(1).alias("weight"))
    total = samples.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n, parts = total["n"], part_count(total["bytes"])
    norms = materialize(document_norms(samples, n, parts, ngram_range, stop_words), "tfidf-norms")
    normed = narrow_join(samples, norms.withColumnRenamed("sample_id", "_id"), F.col("sample_id").eqNullSafe(F.col("_id")))

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in tb.whole_parts(batches):
            terms, codes = tb.dictionary(blocks)
            idf = np.log((1.0 + n) / (1.0 + part_df(blocks, codes, len(terms)))) + 1.0
            for b, c in zip(blocks, codes):
                term, doc, tf = b.occurrences()
                own_idf = idf[c][term]
                yield pa.RecordBatch.from_arrays(
                    [b.kept("sample_id").take(pa.array(doc)), terms.take(pa.array(c[term])), pa.array(b.counts().astype(np.int64)),
                     pa.array(own_idf), pa.array(tf * own_idf / b.numbers("norm")[doc])], names=schema.names)

    packed = tb.term_blocks(normed, ["sample_id", "weight", "norm"], "text", parts, ngram_range, stop_words)
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("term", StringType()), StructField("tf", LongType()),
                         StructField("idf", DoubleType()), StructField("weight", DoubleType())])
    return tb.by_part(packed, parts).mapInArrow(weights, schema)
