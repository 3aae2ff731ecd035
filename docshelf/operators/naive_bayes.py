"""TF-IDF + multinomial Naive Bayes as relational jobs.

Model semantics (the textbook pipeline the engine reproduces):

* term frequency is sublinear, ``1 + ln(tf)``; idf is smoothed,
  ``ln((1 + n) / (1 + df)) + 1``; each document vector is L2-normalised;
* class feature mass ``N_ct`` = sum of the normalised weights of class ``c``,
  ``N_c = sum_t N_ct``, ``log P(t|c) = ln((N_ct + a) / (N_c + a V))``;
  prior ``ln(n_c / n)``; samples may carry an integer weight (corrections
  count three times), which multiplies ``n``, ``df``, ``n_c`` and ``N_ct``;
* scoring: terms outside the vocabulary are ignored, probabilities are the
  soft-max of the joint log likelihoods, the arg-max breaks ties by label.

Sparse form used for scoring. With ``X_d = sum_t x_dt`` (over vocabulary
terms of document ``d``) the joint log likelihood is

    jll(d, c) = prior_c + X_d * base_c + sum_{t in d, N_ct > 0} x_dt * delta_ct
    base_c   = ln(a) - ln(N_c + a V)
    delta_ct = ln(N_ct + a) - ln(a)

so only (term, class) pairs that occurred in training are joined; since
``x = x_raw / norm`` the per-document sums are taken on raw weights and
divided once. The model is two tables: ``classes(label, log_prior, base)``
(bounded by the taxonomy, broadcast) and ``terms(term, idf, deltas, df)`` (one
row per vocabulary term, joined by shuffle unless they are few).

Up to ``DENSE_CLASSES`` classes, the occurrences of terms are shuffled as blocks
(:mod:`.term_blocks`): in fitting twice, for the norms and for the masses, and in
scoring once, to the part of the vocabulary that has their terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..options import CORRECTION_TEXT_CHARS, CORRECTION_WEIGHT, ERROR_CATEGORY, NBOptions
from ..session import estimated_bytes, materialize
from . import skew
from . import term_blocks as tb
from .tfidf import document_norms, part_count
from .tokens import doc_terms

DENSE_CLASSES = 64      # up to so many classes a term's deltas are one vector; the results are the same beyond

PART_TEXT_BYTES = 64 << 20      # training text to a part of the vocabulary: scoring makes rows of sums by part
PACKED_TERMS = 1 << 17      # terms in a row of the packed vocabulary
LOOKUP_TERMS = 1 << 20      # terms of blocks looked up at once, or as many as the part of the vocabulary has


@dataclass
class NBModel:
    classes: DataFrame   # label, n_c, log_prior, base
    terms: DataFrame     # term, idf, deltas array<struct<label, n_ct, delta>>, df, masses
    options: NBOptions
    mass_labels: list[str] | None = None     # labels of the vector ``masses`` in terms, if it is one
    packed: DataFrame | None = None          # the written rows that terms are read from, if there are mass_labels
    parts: int = 0                           # what their terms are dealt to


def training_samples(df: DataFrame, id_col: str, text_col: str, label_col: str,
                     weight: int = 1) -> DataFrame:
    """``(sample_id, text, label, weight)`` from any labelled table."""
    return df.select(
        F.col(id_col).cast("bigint").alias("sample_id"),
        F.col(text_col).alias("text"),
        F.col(label_col).cast("string").alias("label"),
        F.lit(weight).cast("int").alias("weight"),
    )


def with_corrections(samples: DataFrame, corrections: DataFrame, categories: DataFrame | None = None,
                     weight: int = CORRECTION_WEIGHT) -> DataFrame:
    """Training samples plus corrections counted ``weight`` times.

    ``corrections(sample_id, text, label)``; corrections naming a category
    outside ``categories(category)`` are ignored (D11). The whole text trains;
    only what is kept for later runs is cut (:func:`stored_corrections`).
    """
    c = corrections
    if categories is not None:
        c = c.join(categories.select(F.col("category").alias("label")), ["label"], "left_semi")
    c = c.select(F.col("sample_id").cast("bigint"), "text", F.col("label").cast("string"),
                 F.lit(weight).cast("int").alias("weight"))
    return samples.unionByName(c)


def stored_corrections(corrections: DataFrame) -> DataFrame:
    """``(text, label)`` as written to the config: cut to 500 characters, blank ones left out."""
    return corrections.where(~is_blank("text")).select(
        F.substring("text", 1, CORRECTION_TEXT_CHARS).alias("text"), "label")


def _delta(n_ct, a: float):
    return F.log(n_ct + a) - F.log(F.lit(a))


def _packed_terms(normed: DataFrame, labels: list, n: float, parts: int, options: NBOptions) -> DataFrame:
    """The vocabulary: ``part, n_terms, lengths, chars, dfs, masses``, and ``mass``, what each class has of it.

    ``masses`` are per (class, term), without the idf, which is the term's own factor.
    """
    code = F.coalesce(*[F.when(F.col("label").eqNullSafe(F.lit(x)), F.lit(k)) for k, x in enumerate(labels)], F.lit(-1))
    names = ["part", "n_terms", "lengths", "chars", "dfs", "masses", "mass"]

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in tb.whole_parts(batches):
            terms, codes = tb.dictionary(blocks)
            df, total = np.zeros(len(terms)), np.zeros((len(labels), len(terms)))
            for b, c in zip(blocks, codes):
                term, doc, tf = b.occurrences()
                weight, label = b.numbers("weight"), b.numbers("_class")[doc]
                df[c] += np.bincount(term, weight[doc], len(c))
                m = (weight / b.numbers("norm"))[doc] * tf
                for k in range(len(labels)):
                    total[k][c] += np.bincount(term, np.where(label == k, m, 0.0), len(c))
            idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
            for a in range(0, len(terms), PACKED_TERMS):
                own, some = terms.slice(a, PACKED_TERMS), slice(a, a + PACKED_TERMS)
                row = (part, len(own), *tb.pack_terms(own), tb.pack(df[some].astype(np.int64)), tb.pack(total[:, some]),
                       (total[:, some] @ idf[some]).tolist())
                types = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    packed = tb.term_blocks(normed.withColumn("_class", code), ["_class", "weight", "norm"], "text", parts,
                            options.ngram_range, options.stop_words)
    return tb.by_part(packed, parts).mapInArrow(
        masses, "part int, n_terms int, lengths binary, chars binary, dfs binary, masses binary, mass array<double>")


def _unpacked_terms(packed: DataFrame, n_classes: int) -> DataFrame:
    """``term, df, masses``, one row per term of a packed vocabulary."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (tb.Block(batch, i) for i in range(batch.num_rows)):
                terms = b.terms()
                df = tb.unpack(b.value("dfs"), np.int64, len(terms))
                m = tb.unpack(b.value("masses"), np.float64, n_classes * len(terms)).reshape(n_classes, len(terms)).T
                for a in range(0, len(terms), 8192):
                    some = m[a:a + 8192]
                    ends = pa.array(np.arange(len(some) + 1) * n_classes, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [terms.slice(a, 8192), pa.array(df[a:a + 8192]), pa.ListArray.from_arrays(ends, pa.array(some.ravel()))],
                        names=["term", "df", "masses"])

    cols = ["n_terms", F.lit(0).alias("n_occ"), "lengths", "chars", "dfs", "masses"]
    return packed.select(*cols).mapInArrow(rows, "term string, df bigint, masses array<double>")


def fit(samples: DataFrame, options: NBOptions = NBOptions()) -> NBModel:
    """Fit the model tables from ``samples(sample_id, text, label, weight)``.

    Eager: the model tables are written to the shared checkpoint folder, which
    cuts their lineage and gives the scoring join their exact size. Two passes over
    the texts: document frequencies give each sample's norm, which then travels
    with its text to the masses of its terms.
    """
    a = float(options.alpha)
    # one row: the total weight, as a literal so that the written tables keep their exact size estimate
    total = samples.agg(F.sum("weight").cast("double").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = F.lit(total["n"]).cast("double")
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    labels = sorted((r["label"] for r in samples.select("label").distinct().limit(DENSE_CLASSES + 1).collect()),
                    key=lambda x: (x is not None, x))
    dense = len(labels) <= DENSE_CLASSES
    parts = part_count(total["bytes"], PART_TEXT_BYTES)
    if dense:
        norms = document_norms(samples, total["n"] or 0.0, parts, options.ngram_range, options.stop_words)
    else:
        # tokenised twice rather than kept: the exploded corpus is many times its texts. A term is once in a
        # document, so the window of a term holds at most one row per document.
        tf = 1.0 + F.log(F.col("tf").cast("double"))
        dt = doc_terms(samples, "sample_id", "text", options.ngram_range, options.stop_words, keep=["weight"])
        norms = (dt.withColumn("df", F.sum("weight").over(Window.partitionBy("term")))
                 .select("sample_id", (tf * idf).alias("xr"))
                 .groupBy("sample_id").agg(F.sqrt(F.sum(F.col("xr") * F.col("xr"))).alias("norm")))
    norms = materialize(norms, "nb-norms")
    normed = skew.narrow_join(samples, norms.withColumnRenamed("sample_id", "_id"), F.col("sample_id").eqNullSafe(F.col("_id")))
    packed = None
    if dense:
        packed = materialize(_packed_terms(normed, labels, total["n"] or 0.0, parts, options), "nb-terms")
        terms = _unpacked_terms(packed, len(labels)).withColumn("idf", idf)
        n_ct = [F.col("masses")[k] * F.col("idf") for k in range(len(labels))]
        entries = F.array(*[F.struct(F.lit(x).cast("string").alias("label"), m.alias("n_ct"), _delta(m, a).alias("delta"))
                            for x, m in zip(labels, n_ct)]).cast("array<struct<label:string,n_ct:double,delta:double>>")
        # a mass that is 0 stands for a class in which the term was not seen
        deltas = F.filter(entries, lambda e: e["n_ct"] > 0)
        class_mass = packed.agg(*[F.sum(F.col("mass")[k]).alias(f"m{k}") for k in range(len(labels))], F.count(F.lit(1)).alias("v")).select(
            F.inline(F.array(*[F.struct(F.lit(x).cast("string").alias("label"), F.col(f"m{k}").alias("n_c_mass"))
                               for k, x in enumerate(labels)]).cast("array<struct<label:string,n_c_mass:double>>")))
        n_vocab = packed.agg(F.coalesce(F.sum("n_terms"), F.lit(0)).cast("double").alias("v"))
    else:
        # per (term, class) mass without the idf; written as df and masses, which take less room than the values derived from them
        mass = F.col("weight") * tf / F.col("norm")
        terms = materialize(
            doc_terms(normed, "sample_id", "text", options.ngram_range, options.stop_words, keep=["label", "weight", "norm"])
            .groupBy("term", "label").agg(F.sum("weight").alias("df"), F.sum(mass).alias("mass"))
            .groupBy("term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("label", "mass")).alias("masses")),
            "nb-terms").withColumn("idf", idf)
        deltas = F.transform("masses", lambda m: F.struct(
            m["label"].alias("label"), (m["mass"] * F.col("idf")).alias("n_ct"), _delta(m["mass"] * F.col("idf"), a).alias("delta")))
        class_mass = terms.select(F.inline(deltas)).groupBy("label").agg(F.sum("n_ct").alias("n_c_mass"))
        n_vocab = terms.agg(F.count(F.lit(1)).cast("double").alias("v"))
    terms = terms.select("term", "idf", deltas.alias("deltas"), "df", "masses")
    class_count = samples.groupBy("label").agg(F.sum("weight").cast("double").alias("n_c"))
    classes = materialize(
        class_count.join(class_mass, ["label"], "left")
        .crossJoin(F.broadcast(n_vocab))
        .select(
            "label", "n_c",
            F.log(F.col("n_c") / n).alias("log_prior"),
            (F.log(F.lit(a)) - F.log(F.coalesce(F.col("n_c_mass"), F.lit(0.0)) + F.lit(a) * F.col("v"))).alias("base"),
        ),
        "nb-classes",
    )
    return NBModel(classes=classes, terms=terms, options=options, mass_labels=labels if dense else None, packed=packed, parts=parts)


def _class_row(model: NBModel) -> DataFrame:
    """One row with the whole class table as an array (bounded by the taxonomy)."""
    return model.classes.agg(
        F.sort_array(F.collect_list(F.struct("label", "log_prior", "base"))).alias("_classes"),
        F.count(F.lit(1)).alias("_n_classes"),
    )


def _term_hits(dt: DataFrame, terms: DataFrame, few: bool | None = None) -> DataFrame:
    """``dt`` joined to ``terms``: by broadcast if they are few, else by shuffle.

    No salt, which would replicate the vocabulary: a term is once in a document, so the rows of one
    term are no more than the documents. Ordered by hash first: terms share long prefixes.
    """
    if few is None:
        few = estimated_bytes(terms) <= skew.BROADCAST_LIMIT
    t = terms.select(F.col("term").alias("_t"), *[c for c in terms.columns if c != "term"])
    same = F.col("term") == F.col("_t")
    if few:
        return dt.join(F.broadcast(t), same).drop("_t")
    return dt.join(t.hint("merge"), (F.xxhash64("term") == F.xxhash64("_t")) & same).drop("_t")


def _packed_sums(model: NBModel, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document and part of the vocabulary: ``id, xr, sq, d0, d1, ...`` (sums, squares, one sum per class).

    A part's rows of the vocabulary come first, then the blocks, many of which are looked up at once.
    """
    n_classes, alpha = len(model.mass_labels), float(model.options.alpha)
    n = float(model.classes.agg(F.sum("n_c")).first()[0] or 0.0)        # the samples' total weight

    def load(rows: list[tb.Block]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Terms, and their idf and deltas; the last place stands for terms that are unknown."""
        terms = pa.concat_arrays([b.terms() for b in rows])
        df = np.concatenate([tb.unpack(b.value("dfs"), np.int64, b.n_terms) for b in rows])
        idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
        masses = np.concatenate([tb.unpack(b.value("masses"), np.float64, n_classes * b.n_terms).reshape(n_classes, -1) for b in rows], axis=1)
        deltas = np.log(masses * idf + alpha) - np.log(alpha)
        return terms, np.append(idf, 0.0), np.append(deltas, np.zeros((n_classes, 1)), axis=1)

    def look_up(vocabulary, blocks: list[tb.Block]) -> Iterator[pa.RecordBatch]:
        terms, idf, deltas = vocabulary
        found = pc.index_in(pa.concat_arrays([b.terms() for b in blocks]), value_set=terms)
        places = np.split(pc.fill_null(found, len(terms)).to_numpy(), np.cumsum([b.n_terms for b in blocks])[:-1])
        for b, place in zip(blocks, places):
            term, doc, tf = b.occurrences()
            at = place[term]
            known = at < len(terms)
            at, doc = at[known], doc[known]
            x, ids = tf[known] * idf[at], b.kept("_id")
            hit = np.flatnonzero(np.bincount(doc, minlength=len(ids)))
            sums = [x, x * x, *[x * deltas[k][at] for k in range(n_classes)]]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(hit)), *[pa.array(np.bincount(doc, v, len(ids))[hit], pa.float64()) for v in sums]], names=names)

    def score_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, vocabulary, blocks, waiting = None, [], None, [], 0
        for batch in batches:
            for i, (part, is_doc) in enumerate(zip(batch.column("part").to_pylist(), batch.column("_doc").to_pylist())):
                full = vocabulary is not None and waiting >= max(LOOKUP_TERMS, len(vocabulary[0]))
                if blocks and (part != at or full):
                    yield from look_up(vocabulary, blocks)
                    blocks, waiting = [], 0
                if part != at:
                    at, rows, vocabulary = part, [], None
                if not is_doc:
                    rows.append(tb.Block(batch, i))
                elif rows or vocabulary is not None:        # no term of the part is known else
                    if vocabulary is None:
                        vocabulary, rows = load(rows), []
                    blocks.append(tb.Block(batch, i))
                    waiting += blocks[-1].n_terms
        if blocks:
            yield from look_up(vocabulary, blocks)
        del vocabulary, blocks
        pa.default_memory_pool().release_unused()

    packed = tb.term_blocks(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id"], "_text", model.parts,
                            model.options.ngram_range, model.options.stop_words)
    rows = model.packed.drop("mass").withColumn("_doc", F.lit(False)).unionByName(packed.withColumn("_doc", F.lit(True)), allowMissingColumns=True)
    sums = ["xr", "sq", *[f"d{k}" for k in range(n_classes)]]
    names = [id_col, *sums]
    kind = docs.select(id_col).schema.fields[0].dataType.simpleString()
    # a task may have several parts, which are summed up by document before they are shuffled
    return rows.repartition("part").sortWithinPartitions("part", "_doc").mapInArrow(score_part, ", ".join([f"`{id_col}` {kind}", *[f"{c} double" for c in sums]]))


def _dense_sums(model: NBModel, docs: DataFrame, markers: DataFrame, labels: list[str], id_col: str, text_col: str) -> DataFrame:
    """Per document: ``x_sum, norm, blank, hit`` (label -> sum of deltas), as one sum per class.

    Packed blocks meet the packed vocabulary. Where its terms are few, or the model is only tables, terms are joined:
    a term's deltas become a vector in label order before the join, so a hit stays one row and
    documents are summed in one shuffle with map-side combine.
    """
    sums = [f"d{k}" for k in range(len(labels))]
    # packed rows take about half the room of plain ones
    few = model.packed is not None and 2 * estimated_bytes(model.packed) <= skew.BROADCAST_LIMIT
    if model.packed is not None and model.mass_labels == labels and not few:
        hits = _packed_sums(model, docs, id_col, text_col)
    else:
        if model.mass_labels == labels:
            alpha = float(model.options.alpha)
            vector = [_delta(F.col("masses")[k] * F.col("idf"), alpha) for k in range(len(labels))]
            terms = model.terms.select("term", "idf", F.array(*vector).cast("array<double>").alias("_d"))
        else:
            by_label = F.map_from_entries(F.transform("deltas", lambda d: F.struct(d["label"], d["delta"])))
            terms = model.terms.select("term", "idf", by_label.alias("_m")).select(
                "term", "idf", F.array(*[F.coalesce(F.element_at("_m", x), F.lit(0.0)) for x in labels]).alias("_d"))
        dt = doc_terms(docs, id_col, text_col, model.options.ngram_range, model.options.stop_words)
        xr = (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")
        hits = _term_hits(dt, terms, few or None).select(id_col, xr.alias("xr"), "_d").select(
            id_col, "xr", (F.col("xr") * F.col("xr")).alias("sq"), *[(F.col("xr") * F.col("_d")[k]).alias(c) for k, c in enumerate(sums)])
    rows = hits.unionByName(markers.select(id_col, F.lit(0.0).alias("xr"), "blank"), allowMissingColumns=True)
    return rows.groupBy(id_col).agg(
        F.sum("xr").alias("x_sum"), F.sqrt(F.coalesce(F.sum("sq"), F.lit(0.0))).alias("norm"), F.max("blank").alias("blank"),
        F.map_from_arrays(F.array(*map(F.lit, labels)).cast("array<string>"),
                          F.array(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in sums]).cast("array<double>")).alias("hit"))


def _sparse_sums(model: NBModel, docs: DataFrame, markers: DataFrame, labels: list[str], id_col: str, text_col: str) -> DataFrame:
    """The same sums for many classes: a hit becomes one row per class it was seen with."""
    dt = doc_terms(docs, id_col, text_col, model.options.ngram_range, model.options.stop_words)
    hits = _term_hits(dt, model.terms)
    xr = (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    entries = F.transform("deltas", lambda d: F.struct(d["label"].alias("label"), d["delta"].alias("delta")))
    stat_entry = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("delta")))
    contrib = (
        hits.select(id_col, xr.alias("xr"), F.inline(F.concat(entries, stat_entry)))
        .select(
            id_col, "label",
            F.when(F.col("label").isNull(), F.col("xr")).otherwise(F.col("xr") * F.col("delta")).alias("s"),
            F.when(F.col("label").isNull(), F.col("xr") * F.col("xr")).otherwise(F.lit(0.0)).alias("q"),
            F.lit(False).alias("blank"),
        )
    )
    marked = markers.select(id_col, F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), "blank")
    per_label = (
        contrib.unionByName(marked)
        .groupBy(id_col, "label")
        .agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("blank").alias("blank"))
    )
    return per_label.groupBy(id_col).agg(
        F.sum(F.when(F.col("label").isNull(), F.col("s"))).alias("x_sum"),
        F.sqrt(F.sum(F.when(F.col("label").isNull(), F.col("q")))).alias("norm"),
        F.max("blank").alias("blank"),
        F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "s")))).alias("hit"),
    )


def score(model: NBModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, label, confidence)``: arg-max label and its probability, per document.

    Blank texts get label null and confidence 0 (see :func:`gate`). Every
    input document gets exactly one row.
    """
    # one marker row per document, so documents without a known term still score
    markers = docs.select(id_col, is_blank(text_col).alias("blank"))
    labels = [r["label"] for r in model.classes.select("label").orderBy("label").collect()]     # the taxonomy
    sums = _dense_sums if len(labels) <= DENSE_CLASSES else _sparse_sums
    per_doc = sums(model, docs, markers, labels, id_col, text_col)
    scored = (
        per_doc.crossJoin(F.broadcast(_class_row(model)))
        .withColumn("_inv", F.when(F.col("norm") > 0, 1.0 / F.col("norm")).otherwise(F.lit(0.0)))
    )
    scored = scored.select(
        id_col, "blank",
        F.transform(
            "_classes",
            lambda c: F.struct(
                c["label"].alias("label"),
                (c["log_prior"] + F.col("_inv") * (
                    F.col("x_sum") * c["base"]
                    + F.coalesce(F.element_at(F.col("hit"), c["label"]), F.lit(0.0)))).alias("jll"),
            ),
        ).alias("jll"),
    )
    scored = scored.withColumn("_max", F.array_max(F.transform("jll", lambda j: j["jll"])))
    best = F.array_min(F.transform(F.filter("jll", lambda j: j["jll"] == F.col("_max")), lambda j: j["label"]))
    total = F.aggregate("jll", F.lit(0.0), lambda acc, j: acc + F.exp(j["jll"] - F.col("_max")))
    return scored.select(
        id_col,
        F.when(F.col("blank"), F.lit(None).cast("string")).otherwise(best).alias("label"),
        F.when(F.col("blank"), F.lit(0.0)).otherwise(1.0 / total).alias("confidence"),
        F.col("blank"),
    )


def gate(scored: DataFrame, options: NBOptions = NBOptions(), id_col: str = "doc_id") -> DataFrame:
    """Confidence gate.

    Blank text: fallback, 0.0, low. Probability below the threshold: low, and
    the category becomes the fallback while the confidence is kept. A
    missing score (classification failed) is the literal error category.
    """
    low = F.col("blank") | (F.col("confidence") < F.lit(options.threshold))
    category = (
        F.when(F.col("blank"), F.lit(options.fallback))
        .when(F.col("confidence") < F.lit(options.threshold), F.lit(options.fallback))
        .otherwise(F.col("label"))
    )
    return scored.select(
        id_col,
        F.coalesce(category, F.lit(ERROR_CATEGORY)).alias("category"),
        F.coalesce(F.round(F.col("confidence") * 100.0, 1), F.lit(0.0)).alias("confidence_pct"),
        F.coalesce(low, F.lit(True)).alias("is_low"),
    )


def classify(model: NBModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, category, confidence_pct, is_low)`` for every document."""
    return gate(score(model, docs, id_col, text_col), model.options, id_col)
