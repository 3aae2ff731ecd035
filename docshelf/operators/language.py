"""Language gate, names and identification.

Identification is a corpus job: the TF-IDF + NB model of
:mod:`.naive_bayes` trained on documents with a known language code, then
applied to every document. Texts shorter than 20 characters after stripping
are ``unknown``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped_length_at_least
from ..options import LANGUAGE_MIN_CHARS, LANGUAGE_NAMES, NBOptions
from . import naive_bayes as nb


def language_code(text: str | Column, detected: str | Column) -> Column:
    """Detected code, or ``unknown`` for short or failed detection."""
    d = F.col(detected) if isinstance(detected, str) else detected
    return F.when(~stripped_length_at_least(text, LANGUAGE_MIN_CHARS), F.lit("unknown")).otherwise(
        F.coalesce(d, F.lit("unknown")))


def language_name(code: str | Column, upper_fallback: bool = True) -> Column:
    """Display name; unknown codes fall back to the upper-cased code (web) or the code (log)."""
    c = F.col(code) if isinstance(code, str) else code
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGE_NAMES.items())])
    fallback = F.upper(c) if upper_fallback else c
    return F.coalesce(F.element_at(names, c), fallback)


def identify(train: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             code_col: str = "lang", options: NBOptions = NBOptions()) -> DataFrame:
    """``(id, language_code, language)`` for every document of ``docs``.

    ``train`` holds documents with a known ``code_col``; the arg-max class is
    the code (no confidence gate: identification always names a language).
    """
    model = nb.fit(nb.training_samples(train, id_col, text_col, code_col), options)
    # only the short-text flag travels to the join, not the text
    short = docs.select(id_col, (~stripped_length_at_least(text_col, LANGUAGE_MIN_CHARS)).alias("_short"))
    scored = nb.score(model, docs, id_col, text_col).join(short, [id_col])
    code = F.when(F.col("_short"), F.lit("unknown")).otherwise(F.coalesce(F.col("label"), F.lit("unknown")))
    return scored.select(id_col, code.alias("language_code"), language_name(code).alias("language"))
