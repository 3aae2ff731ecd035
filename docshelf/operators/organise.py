"""The organise job as one composed plan.

``scan -> hash -> keep originals -> classify -> rename -> plan destination``;
nothing is moved: the output is the plan (results table) and the history
rows a mover would append. Run ids are literals chosen on the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, char_preview_web, stripped_length_at_least
from ..options import HISTORY_SCHEMA_VERSION, RENAME_MIN_CHARS
from ..session import materialize
from . import dedup
from . import naive_bayes as nb
from .naming import destination_plan, proposed_name_if
from .skew import narrow_join


def new_run_id() -> str:
    """random hex id, evaluated once on the driver and used as a literal."""
    return uuid.uuid4().hex


def organise(files: DataFrame, model: nb.NBModel, root: str, proposals: DataFrame | None = None,
             rename: bool = True, dry_run: bool = False, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Plan a run over ``files(doc_id, path, filename, text)``.

    Returns ``results`` (one row per classified original), ``duplicates``
    (skipped copies). ``proposals(doc_id, raw_name)`` are the suggested new
    names (F2). In a dry run names are not changed and destinations are not
    de-collided (F4).
    """
    hashed = dedup.with_content_hash(files)
    marked = dedup.mark_duplicates(hashed.select("doc_id", "path", "content_hash"))
    duplicates = marked.where("is_duplicate")
    # read twice (scored, then joined back to its columns): only the keys are kept, the texts are scanned again
    firsts = materialize(dedup.keep_originals(hashed.select("doc_id", "path", "content_hash")).select("doc_id"), "originals")
    originals = narrow_join(hashed, firsts, ["doc_id"], "left_semi")
    classified = nb.classify(model, originals.select("doc_id", "text"))
    # of the text only its length matters past here: it stays out of the joins
    res = originals.withColumn("_long", stripped_length_at_least("text", RENAME_MIN_CHARS)).drop("text").join(classified, ["doc_id"])
    if proposals is not None and rename and not dry_run:
        res = res.join(proposals, ["doc_id"], "left").withColumn(
            "new_name", proposed_name_if(F.col("_long"), "filename", "raw_name")).drop("raw_name")
    else:
        res = res.withColumn("new_name", F.col("filename"))
    # read several times by the planner and by reports: without this each read classifies again
    res = materialize(res.drop("_long"), "classified")
    planned = destination_plan(res, root, "category", "new_name", ["doc_id"], existing, dry_run)
    return {"results": planned, "duplicates": duplicates}


def history_rows(results: DataFrame, run_id: str, timestamp: str) -> DataFrame:
    """History records of a run (F8): a rename record when the name changed, then a move.

    ``results(doc_id, path, filename, new_name, dest_path, content_hash)``.
    ``step`` orders the two records of one file; ``seq`` is assigned by the
    writer from (doc_id, step).
    """
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    renamed_path = F.concat(parent, F.lit("/"), F.col("new_name"))
    base = results.select("doc_id", "path", "filename", "new_name", "dest_path", "content_hash",
                          renamed_path.alias("_renamed"))
    rename_rows = base.where(F.col("new_name") != F.col("filename")).select(
        "doc_id", F.lit(0).alias("step"), F.lit("rename").alias("action"),
        F.col("path").alias("source_path"), F.col("_renamed").alias("destination_path"),
        F.col("filename").alias("original_name"), F.col("new_name").alias("final_name"), "content_hash")
    move_rows = base.select(
        "doc_id", F.lit(1).alias("step"), F.lit("move").alias("action"),
        F.when(F.col("new_name") != F.col("filename"), F.col("_renamed")).otherwise(F.col("path")).alias("source_path"),
        F.col("dest_path").alias("destination_path"),
        F.col("new_name").alias("original_name"),
        F.regexp_extract("dest_path", r"([^/]*)$", 1).alias("final_name"), "content_hash")
    return rename_rows.unionByName(move_rows).select(
        "doc_id", "step",
        F.lit(HISTORY_SCHEMA_VERSION).alias("schema_version"), F.lit(run_id).alias("run_id"),
        F.lit(timestamp).alias("timestamp"), "action", "source_path", "destination_path",
        F.col("content_hash").alias("source_hash"), F.col("content_hash").alias("destination_hash"),
        "original_name", "final_name",
    )


def apply_overrides(results: DataFrame, overrides: DataFrame, root: str, web: bool = False) -> DataFrame:
    """Manual category overrides.

    ``overrides(path, override_category)``. Web form (F7): category replaced, ``overridden`` set,
    confidence and low flag kept, destination unchanged. Desktop form (F6): category replaced, low flag
    cleared, and the file moves from where it is now, under its present name, into the new folder,
    where every name present there now is taken. All other files stay as they are, and so does a
    file that is already in its category.
    """
    o = results.join(overrides, ["path"], "left")
    hit = F.col("override_category").isNotNull()
    if web:
        return o.withColumn("category", F.coalesce("override_category", "category")) \
            .withColumn("overridden", hit).drop("override_category")
    o = o.withColumn("overridden", hit).withColumn("is_low", F.when(hit, F.lit(False)).otherwise(F.col("is_low")))
    moves = F.coalesce(F.col("override_category") != F.col("category"), F.lit(False))
    present = results.select(F.regexp_extract("dest_path", r"^(.*)/[^/]*$", 1).alias("dest_dir"),
                             base_name("dest_path").alias("_present_name"))
    moving = o.where(moves).withColumn("category", F.col("override_category")) \
        .withColumn("_present_name", base_name("dest_path")).drop("dest_path")
    planned = destination_plan(moving, root, "category", "_present_name", ["doc_id"], present).drop("_present_name")
    return o.where(~moves).unionByName(planned).drop("override_category")


def override_records(before: DataFrame, after: DataFrame, run_id: str, timestamp: str) -> DataFrame:
    """``move`` records of the files that an override moved (F6), as :func:`history_rows` has them."""
    old = before.select("doc_id", F.col("dest_path").alias("source_path"))
    moved = after.join(old, ["doc_id"]).where(F.col("source_path") != F.col("dest_path"))
    return moved.select(
        "doc_id", F.lit(2).alias("step"), F.lit(HISTORY_SCHEMA_VERSION).alias("schema_version"), F.lit(run_id).alias("run_id"),
        F.lit(timestamp).alias("timestamp"), F.lit("move").alias("action"), "source_path",
        F.col("dest_path").alias("destination_path"), F.col("content_hash").alias("source_hash"),
        F.col("content_hash").alias("destination_hash"), base_name("source_path").alias("original_name"),
        base_name("dest_path").alias("final_name"))


def web_corrections(after: DataFrame, texts: DataFrame) -> DataFrame:
    """What overrides in the web form teach the classifier (F7): the preview it shows, not the whole text."""
    return override_corrections(after, texts.select("doc_id", char_preview_web("text").alias("text")))


def override_corrections(after: DataFrame, texts: DataFrame) -> DataFrame:
    """What overrides teach the classifier: ``(sample_id, text, label)`` for D11 from ``texts(doc_id, text)``.

    The overridden files are written, as fitting reads the corrections several times.
    """
    named = materialize(after.where("overridden").select("doc_id", F.col("category").alias("label")), "overridden")
    return narrow_join(texts, named, ["doc_id"]).select(F.col("doc_id").alias("sample_id"), "text", "label")
