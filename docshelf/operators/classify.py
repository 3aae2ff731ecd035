"""Model choice (D12): one entry point for both classifiers.

``method='nb'`` scores text with the TF-IDF + Naive Bayes model tables;
``method='embedding'`` scores a vector column against category prototypes.
Both return ``(id, category, confidence_pct, is_low)``; the low-confidence
rules differ (NB replaces the category by the fallback, embeddings keep it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import embedding
from . import naive_bayes as nb


def classify(docs: DataFrame, method: str, id_col: str = "doc_id", *, model: nb.NBModel | None = None,
             text_col: str = "text", prototypes: DataFrame | None = None, vec_col: str = "embedding") -> DataFrame:
    if method == "nb":
        if model is None:
            raise ValueError("method 'nb' needs model=")
        return nb.classify(model, docs, id_col, text_col)
    if method == "embedding":
        if prototypes is None:
            raise ValueError("method 'embedding' needs prototypes=")
        return embedding.classify(docs, prototypes, id_col, vec_col)
    raise ValueError(f"unknown method {method!r}: use 'nb' or 'embedding'")
