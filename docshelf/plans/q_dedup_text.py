"""Queries: dedup (C1-C6) and text preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import options as O
from ..functions import text as T
from ..operators import dedup
from ..operators.tokens import doc_terms
from ..sources.tables import documents_as_files, read_table
from .catalog import query
from .sqltext import blank_sql, file_path_sql, term_counts_ctes, words_sql

FILES_SQL = f"SELECT doc_id, {file_path_sql()} AS path, text, lang, md5(text) AS content_hash FROM documents"


def hashed_files(spark, sf_dir):
    """Documents as files with their content hash; scan order is ``doc_id``."""
    return dedup.with_content_hash(documents_as_files(read_table(spark, sf_dir, "documents")))


# --- C1 ---------------------------------------------------------------------

@query("content_hash", f"SELECT doc_id, path, content_hash FROM ({FILES_SQL})")
def content_hash(spark, sf_dir):
    return hashed_files(spark, sf_dir).select("doc_id", "path", "content_hash")


# --- C2 ---------------------------------------------------------------------

@query("mark_duplicates", f"""
WITH f AS ({FILES_SQL}),
firsts AS (SELECT content_hash, arg_min(path, doc_id) AS first_path, min(doc_id) AS first_id
           FROM f WHERE content_hash IS NOT NULL GROUP BY content_hash)
SELECT f.doc_id, f.path, f.content_hash,
       coalesce(f.doc_id <> firsts.first_id, false) AS is_duplicate,
       CASE WHEN f.doc_id <> firsts.first_id THEN firsts.first_path END AS original_path
FROM f LEFT JOIN firsts USING (content_hash)""")
def mark_duplicates(spark, sf_dir):
    return dedup.mark_duplicates(hashed_files(spark, sf_dir).select("doc_id", "path", "content_hash"))


# --- C3 ---------------------------------------------------------------------

@query("duplicate_groups", f"""
WITH f AS ({FILES_SQL}),
g AS (SELECT content_hash, count(*) AS n_copies, arg_min(path, doc_id) AS original_path, min(doc_id) AS first_id
      FROM f GROUP BY content_hash HAVING count(*) > 1)
SELECT f.content_hash, f.doc_id, f.path, g.n_copies, g.original_path, (f.doc_id = g.first_id) AS is_original
FROM f JOIN g USING (content_hash)""")
def duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(hashed_files(spark, sf_dir))


# --- C4 / C5 ----------------------------------------------------------------
# Registry = hashes seen in an earlier run: the labelled documents. Batch =
# the documents not labelled yet.

@query("registry_check", f"""
WITH f AS ({FILES_SQL}),
prev AS (SELECT * FROM f WHERE doc_id IN (SELECT doc_id FROM labels)),
batch AS (SELECT * FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
reg AS (SELECT content_hash, arg_min(path, doc_id) AS first_path FROM prev GROUP BY content_hash),
bfirst AS (SELECT content_hash, arg_min(path, doc_id) AS first_path, min(doc_id) AS first_id
           FROM batch GROUP BY content_hash)
SELECT b.doc_id, b.path, b.content_hash,
       (reg.first_path IS NOT NULL OR b.doc_id <> bf.first_id) AS is_duplicate,
       CASE WHEN reg.first_path IS NOT NULL THEN reg.first_path
            WHEN b.doc_id <> bf.first_id THEN bf.first_path END AS original_path
FROM batch b LEFT JOIN reg USING (content_hash) LEFT JOIN bfirst bf USING (content_hash)""")
def registry_check(spark, sf_dir):
    files = hashed_files(spark, sf_dir).select("doc_id", "path", "content_hash")
    labelled = read_table(spark, sf_dir, "labels").select("doc_id")
    prev = files.join(labelled, ["doc_id"], "left_semi")
    batch = files.join(labelled, ["doc_id"], "left_anti")
    registry = dedup.update_registry(dedup.empty_registry(spark), prev)
    return dedup.check_against_registry(batch, registry)


# --- C6 ---------------------------------------------------------------------

@query("skip_duplicates", f"""
WITH f AS ({FILES_SQL}),
firsts AS (SELECT content_hash, min(doc_id) AS doc_id FROM f GROUP BY content_hash)
SELECT f.doc_id, f.path, f.content_hash FROM f JOIN firsts USING (content_hash, doc_id)""")
def skip_duplicates(spark, sf_dir):
    return dedup.keep_originals(hashed_files(spark, sf_dir)).select("doc_id", "path", "content_hash")


# --- B4-B7 ------------------------------------------------------------------

def _prefix_sql(n: int) -> str:
    return f"array_to_string(list_slice({words_sql('text')}, 1, {n}), ' ')"


@query("word_prefix", f"""
SELECT doc_id, {_prefix_sql(O.PREVIEW_WORDS)} AS preview,
       {_prefix_sql(O.INDEX_SNIPPET_WORDS)} AS snippet,
       {_prefix_sql(O.CLASSIFY_WORDS)} AS classify_text
FROM documents""")
def word_prefix(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        T.word_prefix("text", O.PREVIEW_WORDS).alias("preview"),
        T.word_prefix("text", O.INDEX_SNIPPET_WORDS).alias("snippet"),
        T.word_prefix("text", O.CLASSIFY_WORDS).alias("classify_text"),
    )


@query("word_count", f"SELECT doc_id, CAST(len({words_sql('text')}) AS BIGINT) AS words FROM documents")
def word_count(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("words"))


_STRIP_SQL = r"regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


@query("char_preview", f"""
SELECT doc_id,
       CASE WHEN len({words_sql('text')}) > {O.PREVIEW_WEB_ELLIPSIS_WORDS}
            THEN substr(array_to_string({words_sql('text')}, ' '), 1, {O.PREVIEW_CHARS}) || '...'
            ELSE substr(array_to_string({words_sql('text')}, ' '), 1, {O.PREVIEW_CHARS}) END AS preview_web,
       CASE WHEN length({_STRIP_SQL}) > {O.PREVIEW_CHARS}
            THEN substr({_STRIP_SQL}, 1, {O.PREVIEW_CHARS}) || '…'
            ELSE {_STRIP_SQL} END AS preview_desktop
FROM documents""")
def char_preview(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", T.char_preview_web("text").alias("preview_web"),
                    T.char_preview_desktop("text").alias("preview_desktop"))


# Documents and conversation turns together: turns are short and some are
# blank-ish, documents are long.
@query("blank_gate", f"""
SELECT 'doc' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS seq, {blank_sql('text')} AS is_blank,
       CAST(length({_STRIP_SQL}) AS BIGINT) AS stripped_chars
FROM documents
UNION ALL
SELECT 'turn', conv_id, turn, {blank_sql('text')}, CAST(length({_STRIP_SQL}) AS BIGINT) FROM conversations""")
def blank_gate(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(
        F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("seq"), "text")
    c = read_table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("seq"), "text")
    return d.unionByName(c).select("kind", "id", "seq", T.is_blank("text").alias("is_blank"),
                                   T.trimmed_length("text").cast("bigint").alias("stripped_chars"))


# --- D3 / D4 ----------------------------------------------------------------

@query("tokens_ngrams", lambda: f"""
WITH {term_counts_ctes('d', 'documents', 'doc_id', [])}
SELECT doc_id, term, tf FROM d_tf""")
def tokens_ngrams(spark, sf_dir):
    return doc_terms(read_table(spark, sf_dir, "documents"), "doc_id", "text", O.NGRAM_RANGE)


@query("tfidf_weights", lambda: f"""
WITH {term_counts_ctes('d', 'documents', 'doc_id', [])},
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
v AS (SELECT term, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf FROM d_tf, n GROUP BY term),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS xr FROM d_tf JOIN v USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(xr * xr)) AS norm FROM w GROUP BY doc_id)
SELECT doc_id, term, round(xr / norm, 6) AS weight FROM w JOIN nrm USING (doc_id)""")
def tfidf_weights(spark, sf_dir):
    from ..operators.tfidf import tfidf

    return tfidf(read_table(spark, sf_dir, "documents"), "doc_id", "text", O.NGRAM_RANGE).select(
        "doc_id", "term", F.round("weight", 6).alias("weight"))
