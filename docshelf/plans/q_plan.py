"""Queries: rename and move plans (F1-F9), overrides, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import options as O
from ..functions.text import first_line, first_word, sanitise_name
from ..operators import naive_bayes as nb
from ..operators import naming, organise, reports
from ..session import drop_written, materialize
from ..sources.tables import documents_as_files, read_table
from .catalog import query
from .q_classify import FAILED_SQL, TRAIN_LANG_SQL, labelled_docs, lang_model
from .sqltext import file_path_sql, nb_model_ctes, nb_score_ctes, proposed_name_sql, q, sanitise_sql, suffix_sql, stem_sql, words_sql

ROOT = "organised"
RUN_ID = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"
RUN_TS = "2026-01-01T00:00:00+00:00"

# Proposal for a new name: the first line of the document, as a name model
# would suggest from the text.
def first_line_col():
    return first_line("text")


FIRST_LINE_SQL = "split_part(text, chr(10), 1)"


def proposals(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", first_line_col().alias("raw_name"))


# --- F1 / F2 -----------------------------------------------------------------

@query("sanitise_names", f"""
SELECT doc_id, {FIRST_LINE_SQL} AS raw_name, {sanitise_sql(FIRST_LINE_SQL)} AS stem FROM documents""")
def sanitise_names(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", first_line_col().alias("raw_name"))
    return d.select("doc_id", "raw_name", sanitise_name("raw_name").alias("stem"))


@query("rename_gate", f"""
SELECT doc_id, filename, new_name, new_name <> filename AS renamed FROM (
  SELECT doc_id, CAST(doc_id AS VARCHAR) || '.txt' AS filename,
         {proposed_name_sql("(CAST(doc_id AS VARCHAR) || '.txt')", 'text', FIRST_LINE_SQL)} AS new_name
  FROM documents)""")
def rename_gate(spark, sf_dir):
    files = documents_as_files(read_table(spark, sf_dir, "documents")).withColumn("raw_name", first_line_col())
    return files.select("doc_id", "filename", naming.proposed_name("filename", "text", "raw_name").alias("new_name")) \
        .withColumn("renamed", F.col("new_name") != F.col("filename"))


# --- F3 / F4 -----------------------------------------------------------------
# Names from the first word of the text (lower-cased, sanitised): many files
# share one, so collisions are frequent and some names are hot.

def first_word_col():
    return F.lower(first_word("text"))


FIRST_WORD_SQL = r"lower(regexp_extract_all(text, '[^\s\p{Z}]+')[1])"


def named_files(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("lang").alias("category"),
                    F.concat(F.coalesce(sanitise_name(first_word_col()), F.lit("")), F.lit(".txt")).alias("name"))


NAMED_SQL = f"SELECT doc_id, lang AS category, coalesce({sanitise_sql(FIRST_WORD_SQL)}, '') || '.txt' AS name FROM documents"


@query("destination_plan", f"""
WITH n AS ({NAMED_SQL}),
k AS (SELECT *, row_number() OVER (PARTITION BY category, name ORDER BY doc_id) - 1 AS k FROM n)
SELECT doc_id, category, name,
       '{ROOT}/' || category || '/' || CASE WHEN k = 0 THEN name
            ELSE {stem_sql('name')} || '_' || CAST(k AS VARCHAR) || {suffix_sql('name')} END AS dest_path
FROM k""")
def destination_plan(spark, sf_dir):
    return naming.destination_plan(named_files(spark, sf_dir), ROOT, "category", "name", ["doc_id"])


@query("dry_run_plan", f"""
SELECT doc_id, category, name, '{ROOT}/' || category || '/' || name AS dest_path FROM ({NAMED_SQL})""")
def dry_run_plan(spark, sf_dir):
    return naming.destination_plan(named_files(spark, sf_dir), ROOT, "category", "name", dry_run=True)


# --- F5 / D13: the whole organise plan ----------------------------------------

def _organise_sql_ctes() -> str:
    return f"""WITH f AS (SELECT doc_id, {file_path_sql()} AS path, CAST(doc_id AS VARCHAR) || '.txt' AS filename,
                  text, md5(text) AS content_hash FROM documents),
firsts AS (SELECT content_hash, min(doc_id) AS doc_id FROM f GROUP BY content_hash),
orig AS (SELECT f.* FROM f JOIN firsts USING (content_hash, doc_id)),
train AS ({TRAIN_LANG_SQL}),
score_docs AS (SELECT doc_id, text FROM orig),
{nb_model_ctes('train')},
{nb_score_ctes('score_docs')},
res AS (
  SELECT o.doc_id, o.path, o.filename, o.text, o.content_hash, r.category, r.confidence_pct, r.is_low,
         {proposed_name_sql('o.filename', 'o.text', FIRST_LINE_SQL.replace('text', 'o.text'))} AS new_name
  FROM orig o JOIN nb_result r USING (doc_id)),
planned AS (
  SELECT *, row_number() OVER (PARTITION BY category, new_name ORDER BY doc_id) - 1 AS k FROM res),
results AS (
  SELECT doc_id, path, filename, new_name, content_hash, category, confidence_pct, is_low,
         '{ROOT}/' || category || '/' || CASE WHEN k = 0 THEN new_name
              ELSE {stem_sql('new_name')} || '_' || CAST(k AS VARCHAR) || {suffix_sql('new_name')} END AS dest_path
  FROM planned)"""


def organise_results(spark, sf_dir):
    files = documents_as_files(read_table(spark, sf_dir, "documents")).drop("category")
    model = lang_model(spark, sf_dir)
    plan = organise.organise(files, model, ROOT, proposals(spark, sf_dir))
    drop_written(model.terms)       # the classified rows are written, so nothing reads the vocabulary any more
    return plan


@query("organise_plan", lambda: _organise_sql_ctes() + """
SELECT doc_id, path, filename, new_name, category, confidence_pct, is_low, dest_path FROM results""")
def organise_plan(spark, sf_dir):
    res = organise_results(spark, sf_dir)["results"]
    return res.select("doc_id", "path", "filename", "new_name", "category", "confidence_pct", "is_low", "dest_path")


# --- F8 / F9 / A7: history rows of the run -----------------------------------

@query("history_rows", lambda: _organise_sql_ctes() + f""",
hist AS (
  SELECT doc_id, 0 AS step, 'rename' AS action, path AS source_path,
         regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || new_name AS destination_path,
         filename AS original_name, new_name AS final_name, content_hash
  FROM results WHERE new_name <> filename
  UNION ALL
  SELECT doc_id, 1, 'move',
         CASE WHEN new_name <> filename THEN regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || new_name ELSE path END,
         dest_path, new_name, regexp_extract(dest_path, '([^/]*)$', 1), content_hash
  FROM results)
SELECT CAST(row_number() OVER (ORDER BY doc_id, step) AS BIGINT) AS seq, {O.HISTORY_SCHEMA_VERSION} AS schema_version,
       {q(RUN_ID)} AS run_id, {q(RUN_TS)} AS timestamp, action, source_path, destination_path,
       content_hash AS source_hash, content_hash AS destination_hash, original_name, final_name
FROM hist""")
def history_rows(spark, sf_dir):
    from ..functions.ordinal import with_row_number

    res = organise_results(spark, sf_dir)["results"]
    rows = organise.history_rows(res, RUN_ID, RUN_TS)
    return with_row_number(rows, ["doc_id", "step"], "seq").drop("doc_id", "step")


# --- F6 / F7: overrides ---------------------------------------------------------
# Overrides: toxic labelled documents are moved by hand to the fallback folder.

OVERRIDES_SQL = (f"SELECT {file_path_sql('d')} AS path, {q(O.FALLBACK_CATEGORY)} AS override_category "
                 "FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")


def overrides(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    l = read_table(spark, sf_dir, "labels")
    return d.join(l.where("toxic = 1").select("doc_id"), ["doc_id"], "left_semi").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit(O.FALLBACK_CATEGORY).alias("override_category"))


def _override_ctes() -> str:
    """The overridden files, one after the other: each takes the first free name beside all present ones."""
    numbered = "stem || '_' || CAST({k} AS VARCHAR) || sfx"
    return _organise_sql_ctes().replace("WITH f AS", "WITH RECURSIVE f AS", 1) + f""",
ov AS ({OVERRIDES_SQL}),
o AS (SELECT r.*, ov.override_category IS NOT NULL AS overridden, ov.override_category,
             coalesce(ov.override_category <> r.category, false) AS moves
      FROM results r LEFT JOIN ov USING (path)),
mv AS (SELECT doc_id, name, {stem_sql('name')} AS stem, {suffix_sql('name')} AS sfx,
              row_number() OVER (ORDER BY doc_id) AS rn
       FROM (SELECT doc_id, regexp_extract(dest_path, '([^/]*)$', 1) AS name FROM o WHERE moves)),
present AS (SELECT coalesce(list(regexp_extract(dest_path, '([^/]*)$', 1)), []) AS names FROM results
            WHERE category = {q(O.FALLBACK_CATEGORY)}),
alloc(rn, doc_id, names, final) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), names, CAST(NULL AS VARCHAR) FROM present
  UNION ALL
  SELECT rn, doc_id, list_append(names, final), final FROM (
    SELECT mv.rn, mv.doc_id, a.names,
           CASE WHEN NOT list_contains(a.names, mv.name) THEN mv.name
                ELSE list_filter(list_transform(range(1, len(a.names) + 2), lambda k: {numbered.format(k='k')}),
                                 lambda n: NOT list_contains(a.names, n))[1] END AS final
    FROM alloc a JOIN mv ON mv.rn = a.rn + 1)),
after AS (
  SELECT o.doc_id, o.path, coalesce(o.override_category, o.category) AS category, o.confidence_pct,
         CASE WHEN o.overridden THEN false ELSE o.is_low END AS is_low, o.overridden, o.content_hash,
         o.dest_path AS old_path,
         CASE WHEN o.moves THEN '{ROOT}/' || o.override_category || '/' || a.final ELSE o.dest_path END AS dest_path
  FROM o LEFT JOIN alloc a ON a.doc_id = o.doc_id)"""


def overridden_results(spark, sf_dir):
    before = materialize(organise_results(spark, sf_dir)["results"], "results")
    return before, organise.apply_overrides(before, overrides(spark, sf_dir), ROOT)


@query("override_results", lambda: _override_ctes() + """
SELECT doc_id, path, category, confidence_pct, is_low, overridden, dest_path FROM after""")
def override_results(spark, sf_dir):
    return overridden_results(spark, sf_dir)[1].select(
        "doc_id", "path", "category", "confidence_pct", "is_low", "overridden", "dest_path")


@query("override_moves", lambda: _override_ctes() + f"""
SELECT doc_id, {q(RUN_ID)} AS run_id, 'move' AS action, old_path AS source_path, dest_path AS destination_path,
       content_hash AS source_hash, regexp_extract(old_path, '([^/]*)$', 1) AS original_name,
       regexp_extract(dest_path, '([^/]*)$', 1) AS final_name
FROM after WHERE old_path <> dest_path""")
def override_moves(spark, sf_dir):
    before, after = overridden_results(spark, sf_dir)
    return organise.override_records(before, after, RUN_ID, RUN_TS).select(
        "doc_id", "run_id", "action", "source_path", "destination_path", "source_hash", "original_name", "final_name")


def _override_learn_sql(text: str = "o.text") -> str:
    return f"""WITH f AS (SELECT doc_id, {file_path_sql()} AS path, text, md5(text) AS content_hash FROM documents),
firsts AS (SELECT content_hash, min(doc_id) AS doc_id FROM f GROUP BY content_hash),
orig AS (SELECT f.* FROM f JOIN firsts USING (content_hash, doc_id)),
train AS ({TRAIN_LANG_SQL}
  UNION ALL SELECT o.doc_id, {text}, ov.override_category, {O.CORRECTION_WEIGHT} FROM orig o JOIN ({OVERRIDES_SQL}) ov USING (path)),
score_docs AS (SELECT doc_id, text FROM documents),
{nb_model_ctes('train')},
{nb_score_ctes('score_docs')}
SELECT doc_id, category, confidence_pct, is_low FROM nb_result"""


@query("override_learn", _override_learn_sql)
def override_learn(spark, sf_dir):
    """Overrides become corrections, and the retrained model classifies all documents (F6 into D11)."""
    docs = read_table(spark, sf_dir, "documents")
    _, after = overridden_results(spark, sf_dir)
    learned = organise.override_corrections(after, docs.select("doc_id", "text"))
    samples = nb.training_samples(labelled_docs(spark, sf_dir), "doc_id", "text", "lang")
    return nb.classify(nb.fit(nb.with_corrections(samples, learned)), docs)


@query("override_web", lambda: _organise_sql_ctes() + f""",
ov AS ({OVERRIDES_SQL})
SELECT r.doc_id, coalesce(ov.override_category, r.category) AS category, r.confidence_pct, r.is_low,
       ov.override_category IS NOT NULL AS overridden
FROM results r LEFT JOIN ov USING (path)""")
def override_web(spark, sf_dir):
    res = organise_results(spark, sf_dir)["results"]
    out = organise.apply_overrides(res, overrides(spark, sf_dir), ROOT, web=True)
    return out.select("doc_id", "category", "confidence_pct", "is_low", "overridden")


_PREVIEW_SQL = f"""substr(array_to_string({words_sql('o.text')}, ' '), 1, {O.PREVIEW_CHARS})
  || CASE WHEN len({words_sql('o.text')}) > {O.PREVIEW_WEB_ELLIPSIS_WORDS} THEN '...' ELSE '' END"""


@query("override_web_learn", lambda: _override_learn_sql(_PREVIEW_SQL))
def override_web_learn(spark, sf_dir):
    """Overrides in the web form teach their previews, and the retrained model classifies all documents (F7 into D11)."""
    docs = read_table(spark, sf_dir, "documents")
    after = organise.apply_overrides(organise_results(spark, sf_dir)["results"], overrides(spark, sf_dir), ROOT, web=True)
    learned = organise.web_corrections(after, docs.select("doc_id", "text"))
    samples = nb.training_samples(labelled_docs(spark, sf_dir), "doc_id", "text", "lang")
    return nb.classify(nb.fit(nb.with_corrections(samples, learned)), docs)


# --- G1-G6 / A8 -------------------------------------------------------------------

@query("run_stats", lambda: _organise_sql_ctes() + """,
dups AS (SELECT count(*) AS n FROM f) 
SELECT CAST((SELECT n FROM dups) AS BIGINT) AS total_files, CAST(count(*) AS BIGINT) AS moved,
       CAST((SELECT n FROM dups) - count(*) AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS errors,
       CAST(count(*) FILTER (WHERE is_low) AS BIGINT) AS low_confidence
FROM results""")
def run_stats(spark, sf_dir):
    plan = organise_results(spark, sf_dir)
    return reports.run_stats(plan["results"], plan["duplicates"])


@query("run_stats_errors", lambda: _organise_sql_ctes() + f""",
failed AS (SELECT o.doc_id FROM orig o JOIN ({FAILED_SQL}) l USING (doc_id)),
done AS (SELECT * FROM results WHERE doc_id NOT IN (SELECT doc_id FROM failed))
SELECT CAST((SELECT count(*) FROM f) AS BIGINT) AS total_files, CAST(count(*) AS BIGINT) AS moved,
       CAST((SELECT count(*) FROM f) - (SELECT count(*) FROM results) AS BIGINT) AS duplicates,
       CAST((SELECT count(*) FROM failed) AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE is_low) AS BIGINT) AS low_confidence
FROM done""")
def run_stats_errors(spark, sf_dir):
    """A run in which some files failed: they count as errors, not as moved (G1)."""
    plan = organise_results(spark, sf_dir)
    failed = read_table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    results = plan["results"]
    return reports.run_stats(results.join(failed, ["doc_id"], "left_anti"), plan["duplicates"],
                             results.join(failed, ["doc_id"], "left_semi"))


@query("status_labels", lambda: _organise_sql_ctes() + f""",
ov AS ({OVERRIDES_SQL})
SELECT r.doc_id, CASE WHEN ov.override_category IS NOT NULL THEN {q(O.STATUS_OVERRIDDEN)}
                      WHEN r.is_low THEN {q(O.STATUS_LOW)} ELSE {q(O.STATUS_CONFIDENT)} END AS status
FROM results r LEFT JOIN ov USING (path)""")
def status_labels(spark, sf_dir):
    out = organise.apply_overrides(organise_results(spark, sf_dir)["results"], overrides(spark, sf_dir), ROOT, web=True)
    return out.select("doc_id", reports.status_label().alias("status"))


@query("category_counts", lambda: _organise_sql_ctes() + f""",
cats AS (SELECT DISTINCT lang AS category FROM documents UNION SELECT {q(O.FALLBACK_CATEGORY)}),
counts AS (SELECT category, count(*) AS n_files, count(*) FILTER (WHERE is_low) AS n_low,
                  avg(confidence_pct) AS avg_confidence FROM results GROUP BY category)
SELECT category, CAST(coalesce(n_files, 0) AS BIGINT) AS n_files, CAST(coalesce(n_low, 0) AS BIGINT) AS n_low,
       coalesce(round(avg_confidence, 2), 0.0) AS avg_confidence
FROM cats FULL OUTER JOIN counts USING (category)""")
def category_counts(spark, sf_dir):
    res = organise_results(spark, sf_dir)["results"]
    d = read_table(spark, sf_dir, "documents")
    cats = d.select(F.col("lang").alias("category")).unionByName(
        spark.range(1).select(F.lit(O.FALLBACK_CATEGORY).alias("category")))
    return reports.category_counts(res, cats)


@query("result_metrics", lambda: _organise_sql_ctes() + """
SELECT CAST(count(*) AS BIGINT) AS total, round(avg(confidence_pct), 2) AS avg_confidence,
       CAST(count(*) FILTER (WHERE is_low) AS BIGINT) AS n_low,
       CAST(count(*) FILTER (WHERE new_name IS NOT NULL AND new_name <> filename) AS BIGINT) AS n_renamed
FROM results""")
def result_metrics(spark, sf_dir):
    return reports.result_metrics(organise_results(spark, sf_dir)["results"])


def _export_base(spark, sf_dir):
    from ..operators.language import language_name

    res = organise_results(spark, sf_dir)["results"]
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return res.join(d, ["doc_id"]).withColumn("language", language_name("lang")).withColumn(
        "overridden", F.lit(False))


@query("export_rows", lambda: _organise_sql_ctes() + f"""
SELECT CAST(row_number() OVER (ORDER BY r.doc_id) AS BIGINT) AS row_no, r.filename AS file,
       coalesce(r.new_name, r.filename) AS new_name, r.category, printf('%.1f', r.confidence_pct) AS confidence,
       coalesce(MAP {{{", ".join(f"{q(k)}: {q(v)}" for k, v in O.LANGUAGE_NAMES.items())}}}[d.lang], upper(d.lang)) AS language,
       CASE WHEN r.is_low THEN {q(O.STATUS_LOW)} ELSE {q(O.STATUS_CONFIDENT)} END AS status
FROM results r JOIN documents d USING (doc_id)""")
def export_rows(spark, sf_dir):
    return reports.export_rows(_export_base(spark, sf_dir), ["doc_id"])


@query("export_totals", lambda: _organise_sql_ctes() + """
SELECT CAST(count(filename) AS BIGINT) AS n_files, round(avg(confidence_pct), 2) AS avg_confidence FROM results""")
def export_totals(spark, sf_dir):
    return reports.export_totals(organise_results(spark, sf_dir)["results"])
