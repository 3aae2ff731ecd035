"""Classification by embedding prototypes.

Vectors arrive as a column. A category's prototype is the normalised mean of
its labelled vectors (Spark ML ``Summarizer.mean``: a partially aggregated
``groupBy``, so a category with a third of all vectors is combined map-side).
Each vector is scored against every prototype; the prototype table is bounded
by the taxonomy; its size is checked before it is broadcast. Confidence is the cosine
similarity times 100 rounded to one decimal; low when that rounded value is
under 30 %, and unlike the NB gate the category is kept.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, with_normalised
from ..options import EMBEDDING_LOW_THRESHOLD

BLOCK_PROTOTYPES = 1_000
BROADCAST_BYTES = 64 << 20


def prototypes(labelled: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """``(category, proto array<double>)``: normalised mean vector per category."""
    means = (
        labelled.select(F.col(label_col).alias("category"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
        .groupBy("category").agg(Summarizer.mean(F.col("_v")).alias("_m"))
        .select("category", vector_to_array("_m").alias("_mean"))
    )
    return with_normalised(means, "_mean", "proto").drop("_mean")


def _proto_blocks(protos: DataFrame, n_blocks: int) -> DataFrame:
    """The prototypes as rows of up to about ``BLOCK_PROTOTYPES`` each, in category order."""
    return protos.groupBy(F.pmod(F.xxhash64("category"), F.lit(n_blocks)).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("category", "proto"))).alias("_protos"))


def classify(docs: DataFrame, protos: DataFrame, id_col: str, vec_col: str = "embedding",
             low_threshold: float = EMBEDDING_LOW_THRESHOLD) -> DataFrame:
    """``(id, category, confidence_pct, is_low)``; ties go to the first category in order.

    The prototypes meet the vectors block by block. They are broadcast only up to
    ``BROADCAST_BYTES`` of vectors (counted first); with one block no shuffle follows, with more
    each vector keeps its best of each block and those are compared.
    """
    n, dim = protos.agg(F.count(F.lit(1)), F.max(F.size("proto"))).first()
    blocks = _proto_blocks(protos, max(1, -(-n // BLOCK_PROTOTYPES)))
    if n * (dim or 0) * 8 <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    normed = with_normalised(docs.select(id_col, vec_col), vec_col, "_u")
    sims = (
        normed.crossJoin(blocks)
        .select(id_col, F.transform("_protos", lambda p: F.struct(p["category"].alias("category"),
                                                                 dot(F.col("_u"), p["proto"]).alias("sim"))).alias("_s"))
    )
    best = (
        sims.withColumn("_max", F.array_max(F.transform("_s", lambda s: s["sim"])))
        .select(id_col, F.filter("_s", lambda s: s["sim"] == F.col("_max"))[0].alias("_b"))
    )
    if n > BLOCK_PROTOTYPES:
        tops = best.groupBy(id_col).agg(F.max("_b.sim").alias("_top"))
        best = (best.join(tops, [id_col]).where(F.col("_b.sim") == F.col("_top")).groupBy(id_col)
                .agg(F.min(F.struct("_b.category", "_b.sim")).alias("_b")))
    pct = F.round(F.col("_b.sim") * 100.0, 1)
    return best.select(
        id_col, F.col("_b.category").alias("category"), pct.alias("confidence_pct"),
        (pct / 100.0 < F.lit(low_threshold)).alias("is_low"),
    )
