"""Queries: embedding classification (D8) and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import options as O
from ..operators import dedup, embedding, index, search
from ..session import scratch_path
from ..sources.tables import documents_as_files, read_table
from .catalog import query
from .sqltext import file_path_sql

# --------------------------------------------------------------------------
# Fixture: the embeddings table as an index. Category of a vector is its
# label; the query batch is one prototype (normalised mean) per category.
# --------------------------------------------------------------------------


def vector_index(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("vec/"), F.col("vec_id").cast("string"), F.lit(".bin")).alias("path"),
        F.concat(F.col("vec_id").cast("string"), F.lit(".bin")).alias("filename"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("preview"),
        "embedding",
    )


def prototype_queries(spark, sf_dir, own_category_filter: bool = False):
    protos = embedding.prototypes(read_table(spark, sf_dir, "embeddings"), "label")
    q = protos.select(F.col("category").cast("bigint").alias("query_id"), F.col("proto").alias("qvec"))
    if own_category_filter:
        q = q.withColumn("category_filter", F.concat(F.lit("c"), F.col("query_id").cast("string")))
    return q


SQL_INDEX = """idx AS (
  SELECT 'vec/' || CAST(vec_id AS VARCHAR) || '.bin' AS path, CAST(vec_id AS VARCHAR) || '.bin' AS filename,
         'c' || CAST(label AS VARCHAR) AS category, 'vector ' || CAST(vec_id AS VARCHAR) AS preview,
         CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings)"""

SQL_PROTOS = """pos AS (
  SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
mean AS (SELECT label, i, avg(v) AS m FROM pos GROUP BY label, i),
mnorm AS (SELECT label, sqrt(sum(m * m)) AS nrm FROM mean GROUP BY label),
proto AS (SELECT label, list(CASE WHEN nrm > 0 THEN m / nrm ELSE m END ORDER BY i) AS p
          FROM mean JOIN mnorm USING (label) GROUP BY label)"""


def _sql_queries(own_filter: bool) -> str:
    filt = "'c' || CAST(label AS VARCHAR)" if own_filter else "NULL"
    return f"""qn AS (SELECT label, sqrt(list_sum(list_transform(p, lambda x: x * x))) AS n, p FROM proto),
qs AS (SELECT CAST(label AS BIGINT) AS query_id, list_transform(p, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS q,
              {filt} AS category_filter FROM qn)"""


def _sql_search(own_filter: bool, top_k: int = O.SEARCH_TOP_K, bands: bool = False) -> str:
    band = (f", CASE WHEN score_pct >= {O.SCORE_BAND_HIGH} THEN 'high' WHEN score_pct >= {O.SCORE_BAND_MEDIUM} "
            f"THEN 'medium' ELSE 'low' END AS band") if bands else ""
    return f"""WITH {SQL_INDEX},
{SQL_PROTOS},
{_sql_queries(own_filter)},
scored AS (
  SELECT qs.query_id, idx.path, idx.filename, idx.category, idx.preview, list_dot_product(idx.e, qs.q) AS score
  FROM idx CROSS JOIN qs
  WHERE coalesce(qs.category_filter, '') = '' OR qs.category_filter = idx.category),
ranked AS (
  SELECT *, round(score * 100, 1) AS score_pct,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score * 100, 1) DESC, path) AS rank
  FROM scored WHERE score >= {O.SEARCH_MIN_SCORE})
SELECT query_id, CAST(rank AS BIGINT) AS rank, path, filename, category, score_pct, preview{band}
FROM ranked WHERE rank <= {top_k}"""


# --- D8 ---------------------------------------------------------------------

@query("embedding_classify", f"""
WITH {SQL_PROTOS},
u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
             sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings),
un AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS e FROM u),
sims AS (SELECT vec_id, CAST(label AS BIGINT) AS category, list_dot_product(un.e, proto.p) AS sim
         FROM un CROSS JOIN proto),
best AS (SELECT vec_id, arg_max(category, struct_pack(s := sim, c := -category)) AS category, max(sim) AS sim
         FROM sims GROUP BY vec_id)
SELECT vec_id, category, round(sim * 100, 1) AS confidence_pct, round(sim * 100, 1) / 100.0 < {O.EMBEDDING_LOW_THRESHOLD} AS is_low
FROM best""")
def embedding_classify(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    protos = embedding.prototypes(e, "label").withColumn("category", F.col("category").cast("bigint"))
    return embedding.classify(e, protos, "vec_id")


# --- E3 / E4 / E5 / E6 --------------------------------------------------------

@query("search_batch", _sql_search(False))
def search_batch(spark, sf_dir):
    return search.search_batch(vector_index(spark, sf_dir), prototype_queries(spark, sf_dir))


@query("search_filtered", _sql_search(True))
def search_filtered(spark, sf_dir):
    return search.search_batch(vector_index(spark, sf_dir), prototype_queries(spark, sf_dir, True))


@query("search_topk", _sql_search(False, top_k=20))
def search_topk(spark, sf_dir):
    return search.search_batch(vector_index(spark, sf_dir), prototype_queries(spark, sf_dir),
                               O.SearchOptions(top_k=20))


@query("search_bands", _sql_search(False, bands=True))
def search_bands(spark, sf_dir):
    hits = search.search_batch(vector_index(spark, sf_dir), prototype_queries(spark, sf_dir))
    return hits.withColumn("band", search.score_band())


def clustered_index(spark, sf_dir):
    """The vector index saved by category and cell, as it is read back."""
    import uuid

    idx = vector_index(spark, sf_dir).select(
        "path", "filename", "category", "preview", F.lit(0).cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("mtime_us"), F.md5(F.col("path").cast("binary")).alias("content_hash"),
        F.col("embedding").cast("array<float>"), F.lit(O.INDEX_SCHEMA_VERSION).alias("schema_version"))
    path = scratch_path(spark, f"cells-{uuid.uuid4().hex}")
    index.save(idx, path, cells=32)
    return index.load_cells(spark, path)


@query("search_clustered", _sql_search(False))
def search_clustered(spark, sf_dir):
    return search.search_cells(*clustered_index(spark, sf_dir), prototype_queries(spark, sf_dir))


@query("search_clustered_filtered", _sql_search(True))
def search_clustered_filtered(spark, sf_dir):
    return search.search_cells(*clustered_index(spark, sf_dir), prototype_queries(spark, sf_dir, True))


# --- E1 / E2 / E7 -------------------------------------------------------------
# Current tree: documents after duplicates were removed. Cache: an index built
# earlier from the labelled documents; toxic ones were edited since (their
# cached hash is of an older text).

def current_files(spark, sf_dir):
    files = dedup.with_content_hash(documents_as_files(read_table(spark, sf_dir, "documents")))
    return dedup.keep_originals(files).select(
        "path", "filename", "category", "text", F.length("text").cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("mtime_us"), "content_hash")


def cached_index(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    old = (
        documents_as_files(docs).join(labels.select("doc_id", "toxic"), ["doc_id"])
        .withColumn("text", F.when(F.col("toxic") == 1, F.concat("text", F.lit(" (earlier draft)")))
                    .otherwise(F.col("text")))
        .select("path", "filename", "category", "text", F.length("text").cast("bigint").alias("size"),
                F.lit(0).cast("bigint").alias("mtime_us"), F.md5(F.col("text").cast("binary")).alias("content_hash"))
    )
    return index.encode(old)


_SQL_REFRESH_BASE = f"""WITH f AS (SELECT doc_id, {file_path_sql()} AS path, CAST(doc_id AS VARCHAR) || '.txt' AS filename,
                  lang AS category, text, md5(text) AS content_hash FROM documents),
firsts AS (SELECT content_hash, min(doc_id) AS doc_id FROM f GROUP BY content_hash),
cur AS (SELECT f.path, f.category, CAST(length(f.text) AS BIGINT) AS size, CAST(0 AS BIGINT) AS mtime_us,
               f.content_hash FROM f JOIN firsts USING (content_hash, doc_id)),
old AS (SELECT f.path, CASE WHEN l.toxic = 1 THEN f.text || ' (earlier draft)' ELSE f.text END AS text
        FROM f JOIN labels l USING (doc_id)),
cache AS (SELECT path, CAST(length(text) AS BIGINT) AS size, CAST(0 AS BIGINT) AS mtime_us, md5(text) AS content_hash
          FROM old WHERE regexp_matches(text, '[^\\s\\p{{Z}}]'))"""


@query("index_refresh", _SQL_REFRESH_BASE + """
SELECT cur.path, cur.category, cur.size, cur.content_hash,
       CASE WHEN cache.path IS NOT NULL AND cur.size IS NOT DISTINCT FROM cache.size
                 AND cur.mtime_us IS NOT DISTINCT FROM cache.mtime_us
                 AND cur.content_hash IS NOT DISTINCT FROM cache.content_hash
            THEN 'reused' ELSE 'encoded' END AS action,
       true AS has_vector
FROM cur LEFT JOIN cache USING (path)""")
def index_refresh(spark, sf_dir):
    refreshed = index.refresh(current_files(spark, sf_dir), cached_index(spark, sf_dir))
    return refreshed.select("path", "category", "size", "content_hash", "action",
                            (F.size("embedding") > 0).alias("has_vector"))


@query("index_deleted", _SQL_REFRESH_BASE + """
SELECT cache.path FROM cache LEFT JOIN cur USING (path) WHERE cur.path IS NULL""")
def index_deleted(spark, sf_dir):
    return index.deleted(current_files(spark, sf_dir), cached_index(spark, sf_dir)).select("path")


# --- A9 / A10 / E7 --------------------------------------------------------------

@query("index_round_trip", """
SELECT 'vec/' || CAST(vec_id AS VARCHAR) || '.bin' AS path, 'c' || CAST(label AS VARCHAR) AS category,
       'vector ' || CAST(vec_id AS VARCHAR) AS preview, md5('vec/' || CAST(vec_id AS VARCHAR) || '.bin') AS content_hash,
       CAST(len(embedding) AS BIGINT) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vector_sum,
       CAST(0 AS BIGINT) AS left_after_clear
FROM embeddings""")
def index_round_trip(spark, sf_dir):
    """The vector index as it is read back after a save, beside what a clear leaves of it."""
    import uuid

    idx = vector_index(spark, sf_dir).select(
        "path", "filename", "category", "preview", F.lit(0).cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("mtime_us"), F.md5(F.col("path").cast("binary")).alias("content_hash"),
        F.col("embedding").cast("array<float>"), F.lit(O.INDEX_SCHEMA_VERSION).alias("schema_version"))
    path = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    index.save(idx, path)
    saved = index.load(spark, path)
    index.clear(spark, path)
    left = search.index_size(index.load(spark, path)).withColumnRenamed("index_size", "left_after_clear")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return saved.select("path", "category", "preview", "content_hash", F.size("embedding").cast("bigint").alias("dims"),
                        F.round(total, 6).alias("vector_sum")).crossJoin(F.broadcast(left))      # one row


# --- E1 with E3 / E5: text in, hits out ----------------------------------------------
# Benchmark texts searched in an index of all documents. Feature hashing has no SQL form; the unit
# test holds it against brute force.

@query("search_text")
def search_text(spark, sf_dir):
    files = documents_as_files(read_table(spark, sf_dir, "documents")).select(
        "path", "filename", "category", "text", F.octet_length("text").cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("mtime_us"), F.md5(F.col("text").cast("binary")).alias("content_hash"))
    queries = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return search.search_texts(index.encode(files), queries, index.hashed_vectoriser(), "item_id", "text")
