"""Language identification by hierarchical discrimination.

A text becomes its hashed character n-grams (letters only, whole text). Languages are grouped into
families by average-link clustering of their mean vectors. A linear support vector machine per
family (one against the rest) picks the family; within it, one machine per pair of languages
separates close relatives, and most votes win (then margins, then name).

Training runs as Spark groups, one per machine, on a bounded sample: at most ``rows_per_language``
different labelled texts of each language, those with the smallest hashes. Only the weights come
to the driver.

Defined results: null text, or text without a letter, is ``und`` with score 0; so is every text when
nothing is labelled. With one known language every text with letters gets it. Rows that repeat an id
are predicted one by one; further columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageOptions:
    rows_per_language: int = 500     # bound of the training sample of a language
    grams: tuple[int, ...] = (1, 2, 3)
    bits: int = 13                   # hashed feature space of 2**bits
    steps: int = 120                 # gradient steps of each machine
    penalty: float = 1e-4


@dataclass(frozen=True)
class LanguageModel:
    families: list[list[str]]
    family_weights: np.ndarray       # one row per family; the last column is the intercept
    pairs: list[tuple[str, str]]
    pair_weights: np.ndarray
    opts: LanguageOptions


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def features(text: str | None, opts: LanguageOptions) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of a text as ``(index, value)``, of unit length; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letters()[points]
    if not is_letter.any():
        return None
    signs = np.where(is_letter, points, np.uint32(0x20))
    signs = signs[is_letter | np.concatenate(([True], is_letter[:-1]))]     # one gap between words
    counts = np.zeros(1 << opts.bits)
    for n in opts.grams:
        if len(signs) < n:
            continue
        h = np.full(len(signs) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ signs[k:len(signs) - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        counts += np.bincount(h >> np.uint32(32 - opts.bits), minlength=len(counts))
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at])
    return at, values / np.linalg.norm(values)


def _dense(rows: pd.DataFrame, opts: LanguageOptions) -> np.ndarray:
    x = np.zeros((len(rows), (1 << opts.bits) + 1), np.float32)
    x[:, -1] = 1.0
    for i, (at, values) in enumerate(zip(rows["at"], rows["values"])):
        x[i, at] = values
    return x


def train_machine(x: np.ndarray, positive: np.ndarray, opts: LanguageOptions) -> np.ndarray:
    """Linear SVM (squared hinge, balanced classes) by accelerated gradient steps from zero."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for step in range(opts.steps):
        short = np.maximum(0.0, 1.0 - y * (x @ ahead))
        slope = opts.penalty * ahead - 2.0 * (x.T @ (weight * y * short))
        new = ahead - slope / (4.0 + opts.penalty)      # rows have norm sqrt(2), weights sum to 1
        ahead, w = new + step / (step + 3.0) * (new - w), new
    return w


def group_families(names: list[str], centres: np.ndarray) -> list[list[str]]:
    """Average-link clusters of the languages, about the square root of their number."""
    groups = [[i] for i in range(len(names))]
    near = centres @ centres.T
    while len(groups) > max(1, round(len(names) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2),
                   key=lambda p: (near[np.ix_(groups[p[0]], groups[p[1]])].mean(), -p[0], -p[1]))
        groups[a] += groups.pop(b)
    return sorted(sorted(names[i] for i in g) for g in groups)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang",
        opts: LanguageOptions = LanguageOptions()) -> LanguageModel:
    """Learn from the rows of ``labelled`` with a label and a text."""
    rows = labelled.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null").withColumn("u", F.xxhash64("text"))
    # a threshold per language thins each task's rows before the exact cut; copies do not count
    sizes = rows.select("lang", "u").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    place = F.shiftrightunsigned("u", 11) / float(1 << 53)
    first = Window.partitionBy("lang").orderBy("u", "text")
    sample = (rows.join(F.broadcast(sizes), "lang")       # one row per language
              .where(place * F.col("size") < 2 * opts.rows_per_language).dropDuplicates(["lang", "u"])
              .withColumn("n", F.row_number().over(first)).where(F.col("n") <= opts.rows_per_language))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [features(t, opts) for t in b["text"]]
            keep = [f is not None for f in found]
            yield pd.DataFrame({"lang": b["lang"][keep], "at": [f[0] for f in found if f is not None],
                                "values": [f[1].astype(np.float32) for f in found if f is not None]})

    vectors = written(sample.select("lang", "text").mapInPandas(
        read, "lang string, at array<int>, values array<float>"), "language-sample")

    def centre(g: pd.DataFrame) -> pd.DataFrame:
        mean = _dense(g, opts)[:, :-1].mean(axis=0)
        return pd.DataFrame({"lang": [g["lang"].iloc[0]], "centre": [mean / np.linalg.norm(mean)]})

    centres = sorted(vectors.groupBy("lang").applyInPandas(centre, "lang string, centre array<float>").collect())
    names = [r["lang"] for r in centres]
    if not names:
        return LanguageModel([], np.zeros((0, 0)), [], np.zeros((0, 0)), opts)
    families = group_families(names, np.array([r["centre"] for r in centres]))
    # machines: ("family", i) on all languages; ("pair", a, b) on two
    machines = [(f"f{i}", names, fam) for i, fam in enumerate(families)]
    pairs = [p for fam in families for p in combinations(fam, 2)]
    machines += [(f"p{i}", list(p), [p[0]]) for i, p in enumerate(pairs)]
    plan = vectors.sparkSession.createDataFrame(
        [(m, lang, lang in positive) for m, langs, positive in machines for lang in langs],
        "machine string, lang string, positive boolean")

    def train(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["lang", "order"])
        w = train_machine(_dense(g, opts), g["positive"].to_numpy(bool), opts)
        return pd.DataFrame({"machine": [g["machine"].iloc[0]], "weights": [w]})

    learned = {r["machine"]: r["weights"] for r in
               vectors.withColumn("order", F.xxhash64("at", "values")).join(F.broadcast(plan), "lang")
               .groupBy("machine").applyInPandas(train, "machine string, weights array<float>").collect()}
    size = (1 << opts.bits) + 1
    return LanguageModel(families, np.array([learned[f"f{i}"] for i in range(len(families))]).reshape(-1, size),
                         pairs, np.array([learned[f"p{i}"] for i in range(len(pairs))]).reshape(-1, size), opts)


def classify(text: str | None, model: LanguageModel) -> tuple[str, float]:
    """The language of one whole text and a score between 0 and 1."""
    found = features(text, model.opts) if model.families else None
    if found is None:
        return UNDETERMINED, 0.0
    at, values = found
    margins = model.family_weights[:, at] @ values + model.family_weights[:, -1]
    best = int(np.argmax(margins))
    family = model.families[best]
    certain = 1.0 / (1.0 + np.exp(-4.0 * margins[best])) if len(model.families) > 1 else 1.0
    if len(family) == 1:
        return family[0], float(certain)
    votes, sums = dict.fromkeys(family, 0), dict.fromkeys(family, 0.0)
    for (a, b), w in zip(model.pairs, model.pair_weights):
        if a in votes:
            m = float(w[at] @ values + w[-1])
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
    lang = min(family, key=lambda x: (-votes[x], -sums[x], x))
    return lang, float(certain / (1.0 + np.exp(-4.0 * sums[lang] / (len(family) - 1))))


def predicted(text: Column, model: LanguageModel, spark) -> Column:
    """Struct ``lang, score`` of a text column."""
    shared = spark.sparkContext.broadcast(model)      # languages x 2**bits weights

    @F.pandas_udf("lang string, score double")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame([classify(x, shared.value) for x in t], columns=["lang", "score"])

    return read(text)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language cannot be told, all columns unchanged."""
    found = free_name(docs, "__lang")
    return (docs.withColumn(found, predicted(F.col(text_col).cast("string"), model, docs.sparkSession))
            .where(F.col(f"{found}.lang") != UNDETERMINED).select(*[F.col(f"`{c}`") for c in docs.columns]))
