"""Queries: flagship report, Naive Bayes (D1-D7, D11-D13), language."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import options as O
from ..operators import dedup, embedding, language, reports
from ..operators import naive_bayes as nb
from ..operators.classify import classify
from ..operators.skew import narrow_join
from ..session import materialize
from ..sources.tables import documents_as_files, read_table
from . import q_search  # noqa: F401  (classify_methods repeats its embedding_classify)
from .catalog import ORACLE, query
from .sqltext import file_path_sql, nb_model_ctes, nb_score_ctes, q

# --------------------------------------------------------------------------
# Shared fixture plans
# --------------------------------------------------------------------------


def labelled_docs(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return narrow_join(docs, read_table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"], "left_semi")


def lang_model(spark, sf_dir, options: O.NBOptions = O.NBOptions()):
    """NB on the language code of the labelled documents."""
    return nb.fit(nb.training_samples(labelled_docs(spark, sf_dir), "doc_id", "text", "lang"), options)


def nb_results(spark, sf_dir):
    """``(doc_id, path, filename, text, category, confidence_pct, is_low)`` for every document."""
    files = documents_as_files(read_table(spark, sf_dir, "documents"))
    classified = nb.classify(lang_model(spark, sf_dir), files)
    return files.join(classified, ["doc_id"])


TRAIN_LANG_SQL = ("SELECT doc_id AS sample_id, text, lang AS label, 1 AS weight FROM documents "
                  "WHERE doc_id IN (SELECT doc_id FROM labels)")


def nb_result_sql(train_sql: str = TRAIN_LANG_SQL, docs_sql: str = "SELECT doc_id, text FROM documents",
                  fallback: str = O.FALLBACK_CATEGORY) -> str:
    """``WITH ... nb_result`` prefix (no final SELECT) for the lang model over all documents."""
    return f"""WITH train AS ({train_sql}),
score_docs AS ({docs_sql}),
{nb_model_ctes('train')},
{nb_score_ctes('score_docs', fallback=fallback)}"""


# --------------------------------------------------------------------------
# Flagship: dedup -> NB on language -> zero-filled category report
# --------------------------------------------------------------------------

def _flagship_sql() -> str:
    return f"""WITH f AS (SELECT doc_id, {file_path_sql()} AS path, text, lang, md5(text) AS content_hash FROM documents),
firsts AS (SELECT content_hash, min(doc_id) AS doc_id FROM f GROUP BY content_hash),
orig AS (SELECT f.* FROM f JOIN firsts USING (content_hash, doc_id)),
train AS (SELECT doc_id AS sample_id, text, lang AS label, 1 AS weight FROM orig
          WHERE doc_id IN (SELECT doc_id FROM labels)),
score_docs AS (SELECT doc_id, text FROM orig),
{nb_model_ctes('train')},
{nb_score_ctes('score_docs')},
cats AS (SELECT DISTINCT label AS category FROM train UNION SELECT {q(O.FALLBACK_CATEGORY)}),
counts AS (SELECT category, count(*) AS n_files, count(*) FILTER (WHERE is_low) AS n_low,
                  avg(confidence_pct) AS avg_confidence FROM nb_result GROUP BY category)
SELECT category, CAST(coalesce(n_files, 0) AS BIGINT) AS n_files, CAST(coalesce(n_low, 0) AS BIGINT) AS n_low,
       coalesce(round(avg_confidence, 2), 0.0) AS avg_confidence
FROM cats FULL OUTER JOIN counts USING (category)"""


def flagship_classify_report(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    files = dedup.with_content_hash(documents_as_files(docs))
    firsts = materialize(dedup.keep_originals(files.select("doc_id", "content_hash")).select("doc_id"), "originals")
    originals = narrow_join(files, firsts, ["doc_id"], "left_semi")
    labelled = read_table(spark, sf_dir, "labels").select("doc_id")
    train = nb.training_samples(narrow_join(originals, labelled, ["doc_id"], "left_semi"), "doc_id", "text", "category")
    model = nb.fit(train)
    results = nb.classify(model, originals)
    categories = model.classes.select(F.col("label").alias("category")).unionByName(
        spark.range(1).select(F.lit(O.FALLBACK_CATEGORY).alias("category")))
    return reports.category_counts(results, categories)


query("flagship_classify_report", _flagship_sql)(flagship_classify_report)


# --------------------------------------------------------------------------
# NB on language and on quality
# --------------------------------------------------------------------------

@query("nb_classify", lambda: nb_result_sql() + "\nSELECT doc_id, category, confidence_pct, is_low FROM nb_result")
def nb_classify(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return nb.classify(lang_model(spark, sf_dir), docs)


TRAIN_QUALITY_SQL = ("SELECT d.doc_id AS sample_id, d.text, CAST(l.quality AS VARCHAR) AS label, 1 AS weight "
                     "FROM documents d JOIN labels l USING (doc_id)")


@query("nb_classify_quality",
       lambda: nb_result_sql(TRAIN_QUALITY_SQL) + "\nSELECT doc_id, category, confidence_pct, is_low FROM nb_result")
def nb_classify_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    train = narrow_join(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])
    model = nb.fit(nb.training_samples(train, "doc_id", "text", "quality"))
    return nb.classify(model, docs)


# --------------------------------------------------------------------------
# Corrections counted three times, unknown categories ignored.
# Corrections: toxic labelled documents are filed under the fallback
# category (a valid category); low-quality ones under 'Spam', which is not a
# category and must be ignored.
# --------------------------------------------------------------------------

TRAIN_CORRECTED_SQL = f"""SELECT doc_id AS sample_id, text, lang AS label, 1 AS weight FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL
SELECT d.doc_id, d.text, {q(O.FALLBACK_CATEGORY)}, {O.CORRECTION_WEIGHT}
  FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1"""


@query("nb_with_corrections",
       lambda: nb_result_sql(TRAIN_CORRECTED_SQL) + "\nSELECT doc_id, category, confidence_pct, is_low FROM nb_result")
def nb_with_corrections(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    base = nb.training_samples(labelled_docs(spark, sf_dir), "doc_id", "text", "lang")
    with_labels = narrow_join(docs, labels, ["doc_id"])
    corrections = (
        with_labels.where(F.col("toxic") == 1).select("doc_id", "text", F.lit(O.FALLBACK_CATEGORY).alias("label"))
        .unionByName(with_labels.where(F.col("quality") == 0).select("doc_id", "text", F.lit("Spam").alias("label")))
        .withColumnRenamed("doc_id", "sample_id")
    )
    categories = (
        docs.select(F.col("lang").alias("category")).distinct()
        .unionByName(spark.range(1).select(F.lit(O.FALLBACK_CATEGORY).alias("category")))
    )
    model = nb.fit(nb.with_corrections(base, corrections, categories))
    return nb.classify(model, docs)


# --------------------------------------------------------------------------
# The two methods behind one entry; D13: files that failed
# --------------------------------------------------------------------------

@query("classify_methods", lambda: f"""
SELECT 'nb' AS method, doc_id AS id, category, confidence_pct, is_low FROM ({ORACLE["nb_classify"]})
UNION ALL
SELECT 'embedding', vec_id, CAST(category AS VARCHAR), confidence_pct, is_low FROM ({ORACLE["embedding_classify"]})""")
def classify_methods(spark, sf_dir):
    docs, vectors = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "embeddings")
    by_text = classify(docs, "nb", model=lang_model(spark, sf_dir))
    by_vector = classify(vectors, "embedding", "vec_id", prototypes=embedding.prototypes(vectors, "label"))

    def named(df, method, id_col):
        return df.select(F.lit(method).alias("method"), F.col(id_col).alias("id"), F.col("category").cast("string").alias("category"),
                         "confidence_pct", "is_low")

    return named(by_text, "nb", "doc_id").unionByName(named(by_vector, "embedding", "vec_id"))


FAILED_SQL = "SELECT doc_id FROM labels WHERE quality = 0"


@query("classify_errors", lambda: nb_result_sql() + f""",
failed AS ({FAILED_SQL})
SELECT r.doc_id, CASE WHEN f.doc_id IS NULL THEN r.category ELSE {q(O.ERROR_CATEGORY)} END AS category,
       CASE WHEN f.doc_id IS NULL THEN r.confidence_pct ELSE 0.0 END AS confidence_pct, f.doc_id IS NOT NULL OR r.is_low AS is_low
FROM nb_result r LEFT JOIN failed f USING (doc_id)""")
def classify_errors(spark, sf_dir):
    """Low-quality labelled documents stand for files whose extraction failed: they have no score."""
    docs = read_table(spark, sf_dir, "documents")
    failed = read_table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    scored = nb.score(lang_model(spark, sf_dir), narrow_join(docs, failed, ["doc_id"], "left_anti"))
    return nb.gate(docs.select("doc_id").join(scored, ["doc_id"], "left"))


# --------------------------------------------------------------------------
# Language names and identification
# --------------------------------------------------------------------------

def _lang_name_sql(code: str) -> str:
    pairs = ", ".join(f"{q(k)}: {q(v)}" for k, v in O.LANGUAGE_NAMES.items())
    return f"coalesce(MAP {{{pairs}}}[{code}], upper({code}))"


_STRIPPED_LEN = r"length(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"


@query("language_name", lambda: f"""
SELECT doc_id, code AS language_code, {_lang_name_sql('code')} AS language
FROM (SELECT doc_id, CASE WHEN {_STRIPPED_LEN} < {O.LANGUAGE_MIN_CHARS} THEN 'unknown' ELSE lang END AS code
      FROM documents)""")
def language_name(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    code = language.language_code("text", "lang")
    return d.select("doc_id", code.alias("language_code"), language.language_name(code).alias("language"))


@query("language_identify", lambda: nb_result_sql() + f""",
ident AS (SELECT d.doc_id, CASE WHEN {_STRIPPED_LEN.replace('text', 'd.text')} < {O.LANGUAGE_MIN_CHARS}
                                 THEN 'unknown' ELSE b.label END AS code
          FROM documents d JOIN best b USING (doc_id))
SELECT doc_id, code AS language_code, {_lang_name_sql('code')} AS language FROM ident""")
def language_identify(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(labelled_docs(spark, sf_dir), docs)
