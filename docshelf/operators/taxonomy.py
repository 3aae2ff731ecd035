"""Taxonomy config as tables.

A config JSON document becomes three tables: ``categories(pos, category)``,
``training(category, pos, text)`` and ``corrections(seq, text, category)``,
plus the option scalars. Edits are set operations on those tables; each
returns new tables (nothing mutates in place). Guards that must fail loudly
(unknown category, protected category, duplicate) raise ``TaxonomyError``
after a bounded check (one row) on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordinal import with_row_number
from ..functions.text import strip
from ..options import DEFAULT_KEYWORD_SENTENCE, PROTECTED_CATEGORY

CONFIG_SCHEMA = (
    "categories array<string>, training_data map<string, array<string>>, "
    "corrections array<struct<text: string, category: string>>, "
    "classifier struct<confidence_threshold: double, ngram_range: array<int>, naive_bayes_alpha: double>, "
    "organizer struct<supported_extensions: array<string>, fallback_category: string, recursive: boolean>, "
    "_corrupt_record string"
)


class TaxonomyError(ValueError):
    pass


@dataclass
class Taxonomy:
    categories: DataFrame    # pos, category
    training: DataFrame      # category, pos, text
    corrections: DataFrame   # seq, text, category
    extensions: DataFrame    # pos, extension
    raw: DataFrame           # the parsed document (one row per config file)


def load_config(spark: SparkSession, path: str) -> Taxonomy:
    """Parse a JSON config (one object per file) into tables."""
    raw = spark.read.schema(CONFIG_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    cats = raw.select(F.posexplode("categories").alias("pos", "category")).select(
        F.col("pos").cast("int"), "category")
    training = (
        raw.select(F.explode("training_data").alias("category", "texts"))
        .select("category", F.posexplode("texts").alias("pos", "text"))
        .select("category", F.col("pos").cast("int"), "text")
    )
    corrections = raw.select(F.posexplode("corrections").alias("seq", "c")).select(
        F.col("seq").cast("bigint"), F.col("c.text").alias("text"), F.col("c.category").alias("category"))
    exts = raw.select(F.posexplode("organizer.supported_extensions").alias("pos", "extension"))
    return Taxonomy(cats, training, corrections, exts, raw)


def violations(t: Taxonomy) -> DataFrame:
    """``(rule, item)`` rows; an empty result means the config is valid."""
    # a corrupt document has every field null (Spark refuses a filter on the corrupt column alone)
    parse = t.raw.where(F.col("_corrupt_record").isNotNull() & F.col("categories").isNull()).select(
        F.lit("invalid_json").alias("rule"), F.lit(None).cast("string").alias("item"))
    no_cats = t.raw.where(F.coalesce(F.size("categories"), F.lit(0)) <= 0).select(
        F.lit("no_categories").alias("rule"), F.lit(None).cast("string").alias("item"))
    blank = t.categories.where(F.col("category").isNull() | ~F.col("category").rlike(r"[^\s\p{Z}]")).select(
        F.lit("blank_category").alias("rule"), F.col("category").alias("item"))
    no_training = t.raw.where(F.coalesce(F.size("training_data"), F.lit(0)) <= 0).select(
        F.lit("no_training_data").alias("rule"), F.lit(None).cast("string").alias("item"))
    listed = t.raw.select(F.explode("training_data").alias("category", "texts")).where(F.col("texts").isNotNull())
    missing = t.categories.join(listed, ["category"], "left_anti").select(
        F.lit("missing_training").alias("rule"), F.col("category").alias("item"))
    bad_ext = t.extensions.where(~F.col("extension").startswith(".")).select(
        F.lit("bad_extension").alias("rule"), F.col("extension").alias("item"))
    out = parse
    for df in (no_cats, blank, no_training, missing, bad_ext):
        out = out.unionByName(df)
    return out


def validate(t: Taxonomy, show: int = 20) -> None:
    """Raise when a rule is violated: how many items, and the first ``show`` of them in order."""
    bad = violations(t)
    total = bad.count()
    if total:
        first = ", ".join(f"{r['rule']} {r['item']!r}" for r in bad.orderBy("rule", "item").take(show))
        raise TaxonomyError(f"{total} violations: {first}")


# What each edit asks of the category it names; a rule that does not hold fails the edit under its own name.
EDIT_RULES = {
    "add": ("named", "new", "worded"),
    "delete": ("named", "unprotected", "listed"),
    "update": ("named", "listed", "worded"),
}


def _checked(t: Taxonomy, edit: str, name: str, keywords=None) -> tuple[str, DataFrame | None]:
    """The stripped name and the keyword rows of an edit whose rules all hold."""
    name = name.strip()
    rows = _keyword_rows(t.categories.sparkSession, name, keywords) if keywords is not None else None

    def listed() -> bool:
        return bool(t.categories.where(F.col("category") == name).take(1))

    holds = {
        "named": lambda: bool(name),
        "new": lambda: not listed(),
        "listed": listed,
        "unprotected": lambda: name != PROTECTED_CATEGORY,
        "worded": lambda: bool(rows.take(1)),
    }
    for rule in EDIT_RULES[edit]:
        if not holds[rule]():
            raise TaxonomyError(f"cannot {edit} category {name!r}: it must be {rule}")
    return name, rows


def _keyword_rows(spark: SparkSession, name: str, keywords) -> DataFrame:
    """Keyword sentences: a text is split in lines; lines stripped, blank ones dropped."""
    if isinstance(keywords, str):
        df = spark.createDataFrame([(keywords,)], "t string").select(F.posexplode(F.split("t", r"\r\n|\r|\n")))
    else:
        df = spark.createDataFrame([(list(keywords),)], "t array<string>").select(F.posexplode("t"))
    kept = df.select(strip("col").alias("text"), "pos").where(F.length("text") > 0)
    return with_row_number(kept, ["pos"], "_n").select(
        F.lit(name).alias("category"), (F.col("_n") - 1).cast("int").alias("pos"), "text")


def add_category(t: Taxonomy, name: str, keywords=None) -> Taxonomy:
    """Append a new category with its keyword sentences (a default when none)."""
    default = [DEFAULT_KEYWORD_SENTENCE.format(name=name.strip())]
    name, rows = _checked(t, "add", name, keywords or default)
    next_pos = t.categories.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).cast("int").alias("pos"))
    return replace(t, categories=t.categories.unionByName(next_pos.select("pos", F.lit(name).alias("category"))),
                   training=t.training.where(F.col("category") != name).unionByName(rows))


def delete_category(t: Taxonomy, name: str) -> Taxonomy:
    """Remove a category and its training rows; corrections stay."""
    name, _ = _checked(t, "delete", name)
    return replace(t, categories=t.categories.where(F.col("category") != name),
                   training=t.training.where(F.col("category") != name))


def update_keywords(t: Taxonomy, name: str, keywords) -> Taxonomy:
    """I4: replace a category's keyword sentences."""
    name, rows = _checked(t, "update", name, keywords)
    return replace(t, training=t.training.where(F.col("category") != name).unionByName(rows))


def list_categories(t: Taxonomy) -> DataFrame:
    """Categories in config order."""
    return t.categories.orderBy("pos")


def training_samples(t: Taxonomy) -> DataFrame:
    """``(sample_id, text, label, weight)`` from the training table (labels outside the list train too)."""
    return t.training.select(
        F.xxhash64("category", "pos").alias("sample_id"), "text", F.col("category").alias("label"),
        F.lit(1).alias("weight"))
