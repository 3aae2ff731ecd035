"""Queries: taxonomy config (A6, I1-I5) built from the document languages.

Config: the categories are the document languages in sorted order plus the
fallback; each has two keyword sentences made from its language name. The
validation fixture adds, per language, a category without training data
(the upper-cased code) and an extension without its dot (the code). The edit
fixture adds, deletes and re-keys categories.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import options as O
from ..operators import naive_bayes as nb
from ..operators import taxonomy as tx
from ..operators.language import language_name
from ..session import scratch_path
from ..sources.tables import read_table
from .catalog import query
from .q_classify import nb_result_sql
from .sqltext import q


def write_config(spark, sf_dir, broken: bool = False) -> str:
    """Write the config JSON document derived from the documents; return its path."""
    langs = read_table(spark, sf_dir, "documents").select("lang").distinct()
    # one row: the sorted language codes (bounded by the number of languages)
    cats = langs.agg(F.array_sort(F.collect_list("lang")).alias("langs"))
    # broken variant: an upper-cased copy of every language as a category without
    # training data, and every language code as an extension without its dot
    upper = F.transform("langs", lambda c: F.upper(c))
    cat_list = (F.concat("langs", upper, F.array(F.lit(O.FALLBACK_CATEGORY))) if broken
                else F.concat("langs", F.array(F.lit(O.FALLBACK_CATEGORY))))
    names = F.transform(F.concat("langs", F.array(F.lit(O.FALLBACK_CATEGORY))), lambda c: F.struct(
        c.alias("key"),
        F.array(F.concat(language_name(c), F.lit(" documents")),
                F.concat(F.lit("texts written in "), language_name(c))).alias("value")))
    exts = F.array(*[F.lit(e) for e in O.SUPPORTED_EXTENSIONS])
    if broken:
        exts = F.concat(exts, F.col("langs"))
    doc = cats.select(
        cat_list.alias("categories"),
        F.map_from_entries(names).alias("training_data"),
        F.array().cast("array<struct<text:string,category:string>>").alias("corrections"),
        F.struct(F.lit(O.NB_CONFIDENCE_THRESHOLD).alias("confidence_threshold"),
                 F.array(*[F.lit(n) for n in O.NGRAM_RANGE]).alias("ngram_range"),
                 F.lit(O.NB_ALPHA).alias("naive_bayes_alpha")).alias("classifier"),
        F.struct(exts.alias("supported_extensions"), F.lit(O.FALLBACK_CATEGORY).alias("fallback_category"),
                 F.lit(False).alias("recursive")).alias("organizer"),
    )
    path = scratch_path(spark, f"config-{uuid.uuid4().hex}")
    doc.coalesce(1).write.json(path)
    return path


def _names_sql(code: str) -> str:
    pairs = ", ".join(f"{q(k)}: {q(v)}" for k, v in O.LANGUAGE_NAMES.items())
    return f"coalesce(MAP {{{pairs}}}[{code}], upper({code}))"


_CATS_SQL = f"""langs AS (SELECT DISTINCT lang FROM documents),
cats AS (SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS pos, lang AS category FROM langs
         UNION ALL SELECT CAST((SELECT count(*) FROM langs) AS INTEGER), {q(O.FALLBACK_CATEGORY)}),
training AS (
  SELECT category, CAST(0 AS INTEGER) AS pos, {_names_sql('category')} || ' documents' AS text FROM cats
  UNION ALL SELECT category, CAST(1 AS INTEGER), 'texts written in ' || {_names_sql('category')} FROM cats)"""


@query("taxonomy_load", f"""WITH {_CATS_SQL}
SELECT 'category' AS kind, category, pos, CAST(NULL AS VARCHAR) AS text FROM cats
UNION ALL SELECT 'training', category, pos, text FROM training""")
def taxonomy_load(spark, sf_dir):
    t = tx.load_config(spark, write_config(spark, sf_dir))
    cats = t.categories.select(F.lit("category").alias("kind"), "category", "pos", F.lit(None).cast("string").alias("text"))
    train = t.training.select(F.lit("training").alias("kind"), "category", "pos", "text")
    return cats.unionByName(train)


@query("taxonomy_validate", """
WITH langs AS (SELECT DISTINCT lang FROM documents)
SELECT 'missing_training' AS rule, upper(lang) AS item FROM langs
UNION ALL SELECT 'bad_extension', lang FROM langs""")
def taxonomy_validate(spark, sf_dir):
    t = tx.load_config(spark, write_config(spark, sf_dir, broken=True))
    return tx.violations(t)


def write_faulty_configs(spark, sf_dir) -> str:
    """Three faulty documents built from the languages: corrupt, empty, and one with blank, untrained and dotless entries."""
    langs = read_table(spark, sf_dir, "documents").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    codes = F.array_join("langs", '","')
    docs = langs.select(F.posexplode(F.array(
        F.concat(F.lit("{bad json "), F.array_join("langs", " ")),
        F.lit('{"categories": [], "training_data": {}, "organizer": {"supported_extensions": []}}'),
        F.concat(F.lit('{"categories": [" ","'), codes, F.lit('"], "training_data": {" ": ["x"]}, "organizer": {"supported_extensions": ["'),
                 codes, F.lit('"]}}')),
    )).alias("no", "value"))
    path = scratch_path(spark, f"faulty-{uuid.uuid4().hex}")
    docs.repartition(3, "no").select("value", "no").write.partitionBy("no").text(path)
    return path


@query("taxonomy_validate_rules", """
WITH langs AS (SELECT DISTINCT lang FROM documents)
SELECT 0 AS config, 'invalid_json' AS rule, CAST(NULL AS VARCHAR) AS item
UNION ALL SELECT 0, 'no_categories', NULL UNION ALL SELECT 0, 'no_training_data', NULL
UNION ALL SELECT 1, 'no_categories', NULL UNION ALL SELECT 1, 'no_training_data', NULL
UNION ALL SELECT 2, 'blank_category', ' '
UNION ALL SELECT 2, 'missing_training', lang FROM langs
UNION ALL SELECT 2, 'bad_extension', lang FROM langs""")
def taxonomy_validate_rules(spark, sf_dir):
    """All six rules over three faulty documents."""
    path, out = write_faulty_configs(spark, sf_dir), None
    for k in range(3):
        found = tx.violations(tx.load_config(spark, f"{path}/no={k}")).select(F.lit(k).alias("config"), "rule", "item")
        out = found if out is None else out.unionByName(found)
    return out


@query("taxonomy_model", lambda: nb_result_sql(f"""SELECT 2 * t.pos + hash(t.category) % 1000003 AS sample_id, t.text, t.category AS label, 1 AS weight
  FROM (WITH {_CATS_SQL} SELECT category, pos, text FROM training) t""") + """
SELECT doc_id, category, confidence_pct, is_low FROM nb_result""")
def taxonomy_model(spark, sf_dir):
    """Config to model to classified documents."""
    t = tx.load_config(spark, write_config(spark, sf_dir))
    return nb.classify(nb.fit(tx.training_samples(t)), read_table(spark, sf_dir, "documents"))


_EDIT_ADD = "spam offer\n\n  cheap pills  "
_EDIT_FR = "bonjour texte\nfrançais"


@query("taxonomy_edit", f"""WITH {_CATS_SQL},
cats2 AS (SELECT pos, category FROM cats WHERE category <> 'de'
          UNION ALL SELECT CAST((SELECT max(pos) + 1 FROM cats) AS INTEGER), 'Spam'),
training2 AS (
  SELECT * FROM training WHERE category NOT IN ('de', 'fr')
  UNION ALL SELECT 'Spam', CAST(0 AS INTEGER), 'spam offer'
  UNION ALL SELECT 'Spam', CAST(1 AS INTEGER), 'cheap pills'
  UNION ALL SELECT 'fr', CAST(0 AS INTEGER), 'bonjour texte'
  UNION ALL SELECT 'fr', CAST(1 AS INTEGER), 'français')
SELECT 'category' AS kind, category, pos, CAST(NULL AS VARCHAR) AS text FROM cats2
UNION ALL SELECT 'training', category, pos, text FROM training2""")
def taxonomy_edit(spark, sf_dir):
    t = tx.load_config(spark, write_config(spark, sf_dir))
    t = tx.add_category(t, "  Spam ", _EDIT_ADD)
    t = tx.delete_category(t, "de")
    t = tx.update_keywords(t, "fr", _EDIT_FR)
    cats = tx.list_categories(t).select(F.lit("category").alias("kind"), "category", "pos",
                                        F.lit(None).cast("string").alias("text"))
    train = t.training.select(F.lit("training").alias("kind"), "category", "pos", "text")
    return cats.unionByName(train)
