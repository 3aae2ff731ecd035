"""Search index build and incremental refresh.

An index row: ``path, filename, category, preview, size, mtime_us,
content_hash, embedding array<float>, schema_version``. Vectors come from a
vectoriser column function; the default is Spark ML feature hashing of the
document tokens, L2-normalised (a stand-in for a sentence encoder, which is
a per-row model outside this engine). The whole text is vectorised.

Refresh: the current files' signatures are left-joined to the cached index on
``path``; an item is reused when size, mtime and hash all match (null-safe),
otherwise it is (re-)encoded; cached paths that no longer exist fall out of
the left side and are reported by an anti join. ``force`` ignores the cache.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, word_prefix
from ..options import INDEX_SCHEMA_VERSION, PREVIEW_WORDS
from .tokens import tokens

SIGNATURE = ["size", "mtime_us", "content_hash"]
INDEX_COLUMNS = ["path", "filename", "category", "preview", "size", "mtime_us", "content_hash", "embedding",
                 "schema_version"]
INDEX_SCHEMA = ("path string, filename string, category string, preview string, size bigint, mtime_us bigint, "
                "content_hash string, embedding array<float>, schema_version int")


def hashed_vectoriser(dim: int = 384) -> Callable[[DataFrame, str, str], DataFrame]:
    """Feature-hashing vectoriser: tokens -> hashed counts -> unit vector of ``dim`` floats."""

    def run(df: DataFrame, text_col: str, out: str) -> DataFrame:
        with_tokens = df.withColumn("_vt", tokens(text_col))
        hashed = HashingTF(inputCol="_vt", outputCol="_vh", numFeatures=dim).transform(with_tokens)
        normed = Normalizer(inputCol="_vh", outputCol="_vn", p=2.0).transform(hashed)
        return normed.withColumn(out, vector_to_array("_vn", "float32")).drop("_vt", "_vh", "_vn")

    return run


def encode(files: DataFrame, vectorise=None) -> DataFrame:
    """Index rows for ``files(path, filename, category, text, size, mtime_us, content_hash)``.

    Blank texts are skipped (E1); the preview is the first 60 words.
    """
    vectorise = vectorise or hashed_vectoriser()
    kept = files.where(~is_blank("text"))
    vec = vectorise(kept, "text", "embedding")
    return vec.select(
        "path", "filename", "category", word_prefix("text", PREVIEW_WORDS).alias("preview"),
        F.col("size").cast("bigint"), F.col("mtime_us").cast("bigint"), "content_hash",
        F.col("embedding").cast("array<float>"), F.lit(INDEX_SCHEMA_VERSION).alias("schema_version"),
    )


def valid_cache(cached: DataFrame) -> DataFrame:
    """Cached rows usable for reuse: current schema version, path and hash present."""
    return cached.where((F.col("schema_version") == INDEX_SCHEMA_VERSION) & F.col("path").isNotNull()
                        & F.col("content_hash").isNotNull())


def refresh(files: DataFrame, cached: DataFrame | None, vectorise=None, force: bool = False) -> DataFrame:
    """Index for the current ``files``, reusing unchanged cached items.

    Returns index rows plus ``action`` (``reused`` / ``encoded``).
    """
    if cached is None or force:
        return encode(files, vectorise).withColumn("action", F.lit("encoded"))
    c = valid_cache(cached).select(*[F.col(x).alias(f"c_{x}") for x in INDEX_COLUMNS])
    joined = files.join(c, files["path"] == c["c_path"], "left")
    same = F.lit(True)
    for s in SIGNATURE:
        same = same & F.col(s).eqNullSafe(F.col(f"c_{s}"))
    same = F.col("c_path").isNotNull() & same
    flagged = joined.withColumn("_reuse", same)
    reused = flagged.where("_reuse").select(
        *[F.col(f"c_{x}").alias(x) for x in INDEX_COLUMNS], F.lit("reused").alias("action"))
    to_encode = flagged.where(~F.col("_reuse")).select(*files.columns)
    encoded = encode(to_encode, vectorise).withColumn("action", F.lit("encoded"))
    return reused.unionByName(encoded)


def deleted(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached paths that no longer exist (they fall out of the refreshed index)."""
    return valid_cache(cached).join(files.select("path"), ["path"], "left_anti")


def _versions(spark, path: str) -> tuple[int, str | None]:
    """Number and folder of the newest version; (0, None) when there is none."""
    try:
        r = spark.read.schema("version string, at bigint").parquet(f"{path}/pointer").agg(
            F.max("at").alias("at"), F.max_by("version", "at").alias("version")).first()
    except AnalysisException:
        return 0, None
    return r.at or 0, r.version


def save(index: DataFrame, path: str, cells: int | None = None) -> None:
    """Persist (A9) as a new version, then point to it: readers see the last whole version.

    Items are partitioned by category, so a category filter reads only its folder (E4). With ``cells``, they are
    partitioned by nearest centre too, and each cell's centre and exact radius are kept, so that a search reads only the cells
    that can reach its threshold (:func:`load_cells`). Versions are numbered; two writers that take the same number clash,
    and the later one fails. Earlier versions stay until the caller removes their folders.
    """
    spark, version = index.sparkSession, uuid.uuid4().hex
    at, _ = _versions(spark, path)
    items, folder = index.select(*INDEX_COLUMNS), f"{path}/versions/{version}"
    if cells is None:
        items.write.partitionBy("category").parquet(folder)
    else:
        centres = _centres(items, cells)
        items = items.withColumn("_near", _nearest(centres)("embedding")).select(
            *INDEX_COLUMNS, F.col("_near.cell").alias("cell"), F.col("_near.away").alias("away"))
        items.repartitionByRange("category", "cell", "path").write.partitionBy("category", "cell").parquet(folder)
        _cell_bounds(spark, folder, centres).write.parquet(f"{path}/cells/{version}")
    spark.createDataFrame([(version,)], "version string").write.mode("errorifexists").parquet(f"{path}/pointer/at={at + 1}")


def _centres(items: DataFrame, cells: int) -> list[list[float]]:
    """At most ``cells`` different vectors of the index, drawn by a hash of the path."""
    vectors = items.where("size(embedding) > 0").select(F.col("embedding").cast("array<double>").alias("e"), F.xxhash64("path").alias("h"))
    return [list(r.e) for r in vectors.orderBy("h", "e").limit(cells).dropDuplicates(["e"]).orderBy("h").collect()]


def _nearest(centres: list[list[float]]):
    """UDF: number of the nearest centre of the same width and the distance to it; a vector without one is cell -1."""
    dims = {d: [j for j, c in enumerate(centres) if len(c) == d] for d in {len(c) for c in centres}}
    tables = {d: (np.array(js), np.array([centres[j] for j in js])) for d, js in dims.items()}

    @F.pandas_udf("cell int, away double")
    def near(vectors: pd.Series) -> pd.DataFrame:
        cell, away = np.full(len(vectors), -1), np.zeros(len(vectors))
        width = np.array([0 if v is None else len(v) for v in vectors])
        for d, (numbers, c) in tables.items():
            for at in np.array_split(np.nonzero(width == d)[0], len(vectors) // 2048 + 1):
                if len(at):
                    x = np.stack([np.asarray(vectors.iloc[i], dtype=np.float64) for i in at])
                    gap = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
                    best = np.where(np.isnan(gap), np.inf, gap).argmin(1)
                    cell[at], away[at] = numbers[best], np.sqrt(((x - c[best]) ** 2).sum(1))
        return pd.DataFrame({"cell": cell, "away": away})

    return near


def _cell_bounds(spark, folder: str, centres: list[list[float]]) -> DataFrame:
    """``category, cell, centre, radius``: no item of a cell is farther from its centre than ``radius``."""
    schema = f"{INDEX_SCHEMA}, cell int, away double"
    # rounded up; a vector that is not finite makes its cell unbounded
    radius = F.max(F.when(F.isnan("away"), F.lit(float("inf"))).otherwise(F.col("away") * (1 + 1e-9) + 1e-9))
    reach = spark.read.schema(schema).parquet(folder).groupBy("category", "cell").agg(radius.alias("radius"))
    table = spark.createDataFrame([(j, c) for j, c in enumerate(centres)], "cell int, centre array<double>")
    return reach.join(F.broadcast(table), "cell", "left").select("category", "cell", "centre", "radius")


def load(spark, path: str) -> DataFrame:
    """Load a saved index; a missing index is empty."""
    _, version = _versions(spark, path)
    if version is None:
        return spark.createDataFrame([], INDEX_SCHEMA)
    return valid_cache(spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/versions/{version}").select(*INDEX_COLUMNS))


def load_cells(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Items with their ``cell``, and ``category, cell, centre, radius``, of an index saved with ``cells``."""
    _, version = _versions(spark, path)
    bounds = "category string, cell int, centre array<double>, radius double"
    if version is None:
        return spark.createDataFrame([], f"{INDEX_SCHEMA}, cell int"), spark.createDataFrame([], bounds)
    items = spark.read.schema(f"{INDEX_SCHEMA}, cell int").parquet(f"{path}/versions/{version}")
    return valid_cache(items), spark.read.schema(bounds).parquet(f"{path}/cells/{version}")


def clear(spark, path: str) -> DataFrame:
    """Reset to an empty index of the same schema (A10)."""
    empty = spark.createDataFrame([], INDEX_SCHEMA)
    save(empty, path)
    return empty
