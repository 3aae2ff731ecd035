"""Vector top-k search over an index table.

Exact search: every index item is scored against every query of a batch.
Query vectors go to all tasks (their size is measured first), blocks of index rows are scored as one matrix product, what is at
or above ``min_score`` (tested unrounded) and may be among a query's best of its block is kept, and the per-query top-k is a
``row_number`` filter that Spark turns into a partial ``WindowGroupLimit`` before the shuffle, so each
task forwards at most k rows per query no matter how many items match.

Ranking follows the reproduced behaviour: sort by the score *rounded to one
decimal* descending, ties in index order (``path``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import is_blank
from ..functions.vectors import with_normalised
from ..options import SCORE_BAND_HIGH, SCORE_BAND_MEDIUM, SearchOptions

BATCH_BYTES = 64 << 20      # query vectors sent to the tasks at once
BLOCK_SCORES = 4 << 20      # scores of a block of index rows with all queries of a pass


def search_batch(index: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions(),
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(query_id, rank, path, filename, category, score_pct, preview)``.

    ``index(path, filename, category, preview, embedding)``; queries carry an
    optional ``category_filter`` (null or empty = no filter), applied before
    scoring. Queries must already exclude blank texts (E8); an empty index
    gives no rows by construction. Vectors that are null, hold a null or have different lengths have no score.

    The size of the queries' vectors is measured; what does not fit in ``batch_bytes`` is split by a hash
    of ``query_id`` into passes over the index (a query's top-k never spans passes).
    """
    qs = queries if "category_filter" in queries.columns else queries.withColumn(
        "category_filter", F.lit(None).cast("string"))
    n, dim = qs.agg(F.count(F.lit(1)), F.max(F.size("qvec"))).first()
    passes = max(1, -(-n * (dim or 0) * 8 // batch_bytes))
    qs = with_normalised(qs, "qvec", "_qu").select("query_id", "_qu", "category_filter")
    items = index.select("path", "filename", "category", "preview", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = StructType([*items.schema.fields[:-1], qs.schema["query_id"], StructField("score", DoubleType())])
    out = None
    for k in range(passes):
        part = (qs if passes == 1 else qs.where(F.pmod(F.hash("query_id"), F.lit(passes)) == k)).toArrow()
        part = part.filter(_whole(part["_qu"].combine_chunks()))
        widths = pc.list_value_length(part["_qu"]).to_numpy()
        for width in np.unique(widths):
            some = part.filter(pa.array(widths == width))
            vectors = some["_qu"].combine_chunks().flatten().to_numpy().reshape(len(some), int(width))
            hits = items.mapInArrow(_block_scores(some["query_id"].combine_chunks(), vectors, some["category_filter"].to_pylist(),
                                                  options, schema.names), schema)
            hits = _ranked(hits, options)
            out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = _ranked(items.sparkSession.createDataFrame([], schema), options)
    return out


def _whole(vectors: pa.Array) -> pa.Array:
    """Whether a vector is there and holds no null."""
    flat = vectors.flatten()
    ok = vectors.is_valid().to_numpy(zero_copy_only=False)
    if flat.null_count:
        gaps = pc.list_parent_indices(vectors).filter(flat.is_null())
        ok = ok.copy()
        ok[gaps.to_numpy()] = False
    return pa.array(ok)


def _block_scores(ids: pa.Array, vectors: np.ndarray, filters: list, options: SearchOptions, names: list[str]):
    """Function for ``mapInArrow``: the items that may be among the best of a query, with their scores.

    Only what cannot be among the ``top_k`` of its block is left out: less by more than scores are rounded by than ``top_k``
    others. What is kept is scored again in the order of its components, as the sum is defined.
    """
    least, width, top_k = options.min_score, vectors.shape[1], options.top_k
    filtered = [(q, f) for q, f in enumerate(filters) if f]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, min(1024, BLOCK_SCORES // max(len(vectors), 1)))
        for batch in batches:
            batch = batch.filter(_whole(batch.column("embedding")))
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), width))
            x = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, width)
            for at in range(0, batch.num_rows, rows):
                block, own = batch.slice(at, rows), x[at:at + rows]
                near = own @ vectors.T
                near[np.isnan(near)] = np.inf       # NaN counts as the largest score
                # how far a product may be from the sum in order (queries have length one)
                off = np.nan_to_num(1e-12 * np.abs(own).sum(axis=1), nan=0.0, posinf=0.0)[:, None]
                if filtered:
                    category = np.array(block.column("category").to_pylist(), dtype=object)
                    for q, f in filtered:
                        near[category != f, q] = -np.inf
                if len(own) > top_k:
                    floor = np.partition(near - off, len(own) - top_k, axis=0)[len(own) - top_k] - 0.002
                else:
                    floor = np.full(len(vectors), -np.inf)
                i, j = np.nonzero((near + off >= np.maximum(floor, least - 1e-9)) & (near > -np.inf))
                score = np.concatenate([np.zeros(0), *[np.cumsum(own[i[p:p + 65536]] * vectors[j[p:p + 65536]], axis=1)[:, -1]
                                                       for p in range(0, len(i) if width else 0, 65536)]])
                if not width:
                    score = np.zeros(len(i))
                hit = ~(score < least)
                found, asked = pa.array(i[hit]), pa.array(j[hit])
                yield pa.RecordBatch.from_arrays([*[block.column(c).take(found) for c in names[:-2]], ids.take(asked), pa.array(score[hit])],
                                                 names=names)

    return run


def _ranked(scored: DataFrame, options: SearchOptions) -> DataFrame:
    scored = scored.withColumn("score_pct", F.round(F.col("score") * 100.0, 1))
    w = Window.partitionBy("query_id").orderBy(F.col("score_pct").desc(), F.col("path"))
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= options.top_k)
        .select("query_id", F.col("rank").cast("bigint").alias("rank"), "path", "filename", "category",
                "score_pct", "preview")
    )


def reachable_cells(cells: DataFrame, vectors: np.ndarray, filters: list[str | None], min_score: float) -> list[tuple]:
    """``(category, cell)`` of the cells in which some query may reach ``min_score``.

    A score is at most the centre's score plus the radius, as queries have length one (or zero).
    """
    found = []
    for r in cells.collect():       # one row per cell and category, as many as the index was saved with
        asks = [k for k, f in enumerate(filters) if not f or f == r.category]
        if not asks:
            continue
        same = r.centre is not None and len(r.centre) == vectors.shape[1]
        top = float((vectors[asks] @ np.asarray(r.centre)).max()) + r.radius if same else np.inf
        if not top < min_score - 1e-9:
            found.append((r.category, r.cell))
    return found


def search_cells(items: DataFrame, cells: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions(),
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """As :func:`search_batch`, over an index saved with cells (:func:`docshelf.operators.index.load_cells`).

    Cells that cannot reach ``min_score`` for any query are not read (partition filters). The others are scored block by
    block as one matrix product of index rows and queries; what comes near the threshold is scored again in the order of
    its components, so scores equal those of :func:`search_batch`. Queries of one pass fit in ``batch_bytes``.
    """
    qs = queries if "category_filter" in queries.columns else queries.withColumn("category_filter", F.lit(None).cast("string"))
    qs = with_normalised(qs, "qvec", "_qu").select("query_id", "_qu", "category_filter")
    n, dim = qs.agg(F.count(F.lit(1)), F.max(F.size("_qu"))).first()
    kind = dict(qs.dtypes)["query_id"]
    schema = f"query_id {kind}, path string, filename string, category string, preview string, score double"
    out = None
    passes = max(1, -(-n * (dim or 0) * 8 // batch_bytes))
    for k in range(passes):
        part = qs if passes == 1 else qs.where(F.pmod(F.hash("query_id"), F.lit(passes)) == k)
        for width, rows in itertools.groupby(sorted(part.collect(), key=lambda r: len(r._qu)), key=lambda r: len(r._qu)):
            rows = list(rows)
            hits = _scored_cells(items, cells, [r.query_id for r in rows], np.array([r._qu for r in rows]).reshape(len(rows), width),
                                 [r.category_filter for r in rows], options, schema)
            out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = items.sparkSession.createDataFrame([], schema)
    return _ranked(out, options)


def _scored_cells(items: DataFrame, cells: DataFrame, ids: list, vectors: np.ndarray, filters: list, options: SearchOptions,
                  schema: str) -> DataFrame:
    by_category: dict = {}
    for category, cell in reachable_cells(cells, vectors, filters, options.min_score):
        by_category.setdefault(category, []).append(cell)
    wanted = F.lit(False)
    for category, numbers in by_category.items():
        wanted = wanted | (F.col("category").eqNullSafe(F.lit(category)) & F.col("cell").isin(numbers))
    least, width = options.min_score, vectors.shape[1]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[v is not None and len(v) == width for v in b["embedding"]]].reset_index(drop=True)
            for at in range(0, len(b), 1024):
                block = b.iloc[at:at + 1024]
                x = np.stack([np.asarray(v, dtype=np.float64) for v in block["embedding"]])
                i, j = np.nonzero(x @ vectors.T >= least - 1e-9)
                exact = np.concatenate([np.cumsum(x[i[p:p + 65536]] * vectors[j[p:p + 65536]], axis=1)[:, -1]
                                        for p in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
                rows = block.iloc[i].drop(columns="embedding").assign(query_id=[ids[q] for q in j], score=exact)
                keep = [s >= least and (not filters[q] or filters[q] == c) for s, q, c in zip(exact, j, rows["category"])]
                yield rows[keep][["query_id", "path", "filename", "category", "preview", "score"]]

    return items.where(wanted).select("path", "filename", "category", "preview", "embedding").mapInPandas(score, schema)


def search(index: DataFrame, query_vec: list[float], options: SearchOptions = SearchOptions()) -> DataFrame:
    """One query (E3/E4): ``(rank, path, filename, category, score_pct, preview)``."""
    spark = index.sparkSession
    if options.category:
        index = index.where(F.col("category") == options.category)      # a saved index is partitioned by category
    q = spark.createDataFrame([(0, [float(x) for x in query_vec], options.category)],
                              "query_id bigint, qvec array<double>, category_filter string")
    return search_batch(index, q, options).drop("query_id")


def queries_from_text(df: DataFrame, id_col: str, text_col: str, vec_col: str) -> DataFrame:
    """Query batch from texts with vectors; blank queries return nothing."""
    return df.where(~is_blank(text_col)).select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("qvec"))


def search_texts(index: DataFrame, texts: DataFrame, vectorise, id_col: str, text_col: str,
                 options: SearchOptions = SearchOptions()) -> DataFrame:
    """Text in, hits out: query texts get vectors from the index's own vectoriser."""
    vectors = vectorise(texts.where(~is_blank(text_col)).select(id_col, text_col), text_col, "_qvec")
    return search_batch(index, queries_from_text(vectors, id_col, text_col, "_qvec"), options)


def score_band(score_pct: str = "score_pct"):
    """``high`` at 60 and above, ``medium`` at 40 and above, else ``low``."""
    s = F.col(score_pct)
    return F.when(s >= SCORE_BAND_HIGH, F.lit("high")).when(s >= SCORE_BAND_MEDIUM, F.lit("medium")).otherwise(F.lit("low"))


def index_size(index: DataFrame) -> DataFrame:
    """One row with the number of items."""
    return index.agg(F.count(F.lit(1)).cast("bigint").alias("index_size"))
