"""Raw files: listing, filtering, decoding.

Files are read with Spark's ``binaryFile`` source. Listing-only work selects
no ``content`` column, so Spark lists and filters paths without reading
bytes; ``content`` is read only for files that pass the filters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dispatch_extension, extension
from ..options import SUPPORTED_EXTENSIONS

# extractor kind per dispatch extension (B3); anything else has no text
EXTRACTOR_KIND = {
    "txt": "text", "csv": "text", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx",
    "eml": "eml", "msg": "msg", "zip": "zip", "png": "image", "jpg": "image", "jpeg": "image",
}


def _strip_scheme(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:", "")


def list_files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """``(path, modificationTime, length)`` of files under ``root`` (no content read)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    df = reader.load(root)
    return df.select(_strip_scheme(F.col("path")).alias("path"), "modificationTime", "length")


def relative_parts(path: str | Column, root: str) -> Column:
    """Path parts below ``root`` (array)."""
    p = F.col(path) if isinstance(path, str) else path
    prefix = root.rstrip("/") + "/"
    return F.split(F.regexp_replace(p, "^" + re.escape(prefix), ""), "/")


def suffix_glob(extensions: list[str] = SUPPORTED_EXTENSIONS) -> str:
    """Case-insensitive ``pathGlobFilter`` for the suffixes, e.g. ``{*.[tT][xX][tT],...}``.

    Pushed into the file listing, so unsupported files are never opened.
    """
    def ci(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext.lstrip("."))
    return "{" + ",".join(f"*.{ci(e)}" for e in extensions) + "}"


def supported(path: str | Column, extensions: list[str] = SUPPORTED_EXTENSIONS) -> Column:
    """Lower-cased suffix is in the list (B9); ``pathGlobFilter`` is case sensitive, so filter on the column."""
    return extension(path).isin(*[e.lower() for e in extensions])


def scan_filter(listing: DataFrame, root: str, categories: list[str] | DataFrame,
                recursive: bool = False, extensions: list[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """A1: supported files, top level or recursive, not inside a category folder.

    ``listing(path)``. A file whose first part below the root is a category
    name is already organised and skipped.
    """
    parts = relative_parts("path", root)
    df = listing.withColumn("_parts", parts)
    if not recursive:
        df = df.where(F.size("_parts") == 1)
    df = df.where(supported("path", extensions))
    first = F.col("_parts")[0]
    if isinstance(categories, DataFrame):
        cats = categories.select(F.col("category").alias("_first"))
        df = df.withColumn("_first", F.when(F.size("_parts") > 1, first)) \
            .join(cats, ["_first"], "left_anti").drop("_first")
    else:
        df = df.where(~((F.size("_parts") > 1) & first.isin(*categories)))
    return df.drop("_parts")


def scan_tree(listing: DataFrame, root: str, categories: DataFrame,
              extensions: list[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """A2: files under category folders, any depth; category = folder name."""
    parts = relative_parts("path", root)
    df = listing.withColumn("_parts", parts).where(F.size("_parts") > 1) \
        .withColumn("category", F.col("_parts")[0]).drop("_parts")
    df = df.where(supported("path", extensions))
    return df.join(categories.select("category"), ["category"], "left_semi")


def extractor_kind(path: str | Column) -> Column:
    """Extractor for the text after the last dot of the path; unknown -> ``none``."""
    ext = dispatch_extension(path)
    m = F.create_map(*[F.lit(x) for kv in EXTRACTOR_KIND.items() for x in kv])
    return F.coalesce(F.element_at(m, ext), F.lit("none"))


# The well-formed UTF-8 sequences, as characters of a Latin-1 view of the bytes.
UTF8_SEQUENCE = ("[\\x00-\\x7F]|[\\xC2-\\xDF][\\x80-\\xBF]|\\xE0[\\xA0-\\xBF][\\x80-\\xBF]|[\\xE1-\\xEC\\xEE\\xEF][\\x80-\\xBF]{2}"
                 "|\\xED[\\x80-\\x9F][\\x80-\\xBF]|\\xF0[\\x90-\\xBF][\\x80-\\xBF]{2}|[\\xF1-\\xF3][\\x80-\\xBF]{3}|\\xF4[\\x80-\\x8F][\\x80-\\xBF]{2}")


def decode_text(content: str | Column) -> Column:
    """B1: UTF-8 with malformed bytes dropped, universal newlines.

    Bytes that are well formed as a whole are taken as they are. Otherwise the well-formed sequences are kept
    and every other byte is dropped, so a genuine U+FFFD of the file stays.
    """
    c = F.col(content) if isinstance(content, str) else content
    latin = F.regexp_replace(F.decode(c, "ISO-8859-1"), f"(?s)({UTF8_SEQUENCE})|.", "$1")
    kept = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.encode(latin, "ISO-8859-1").cast("string"))
    return F.regexp_replace(kept, "\r\n?", "\n")


def read_texts(spark: SparkSession, root: str, categories: list[str] | DataFrame, recursive: bool = False) -> DataFrame:
    """A3 for plain-text files: ``(path, filename, ext, text, status)``.

    Files of other kinds need their own parser; they come back with a null text and the status
    ``unread``, so that a run counts them as errors instead of filing them as blank documents.
    """
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", suffix_glob()).load(root)
        .select(_strip_scheme(F.col("path")).alias("path"), "content")
    )
    files = scan_filter(raw, root, categories, recursive)
    is_text = extractor_kind("path") == "text"
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), extension("path").alias("ext"),
        F.when(is_text, decode_text("content")).alias("text"),
        F.when(is_text, "read").otherwise("unread").alias("status"),
    )
