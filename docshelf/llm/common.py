"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize

TOKENIZER_FILES = ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file in the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_text(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_key, doc_id, text``: one row per input row, whatever its id.

    Other columns are left behind here, so their names cannot clash with the operator's own.
    ``row_key`` tells apart rows whose id is null or repeated; callers write it to a table
    before they use it twice.
    """
    return docs.select(F.monotonically_increasing_id().alias("row_key"),
                       F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces_of(text: Column, chars: int) -> Column:
    """``text`` cut into consecutive pieces of at most ``chars`` code points (one linear pass)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back (cuts the lineage)."""
    return materialize(df, f"llm-{name}", compression)
