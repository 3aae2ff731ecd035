"""Centroid clustering with ns-bounds: exact k-means over integer vectors.

Every vector carries, for each centroid, its distance at the round in which that pair was last
evaluated. The centroids of all rounds are kept (rounds x k x dim integers), so a stored distance is
loosened by the norm of the centroid's *total* displacement since its evaluation, which is never more
than the sum of its drifts round by round. A vector none of whose bounds reach its own distance keeps
its centroid unread; for all others the own distance is evaluated first, and then exactly those pairs
whose bound still reaches it. Distances and sums are integers, so results do not depend on order.

One round is one scan of the state table (components, centroid, stored distances): rows never move
between partitions. The new centroids need only the vectors that changed sides; each task sums them
per centroid and component, and Spark adds these partial sums. Only sums of k x dim values reach the
driver. The table of a round is written under the checkpoint folder and dropped once the next is written.

Defined results: a vector is kept when it has exactly ``dim`` components, none null, non-finite or
beyond 1e60; other rows are left out. Rows that repeat an id or a vector are rows of their own. Rows with a
null id are clustered but come last when the first centroids are chosen; of equal ids the one whose
components sort first comes first. With fewer than ``k`` kept rows each starts a centroid; an empty table gives
an empty result. Distances and sums beyond 64 bits are null. Only the id and vector columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_written
from .common import written

EXACT = 1 << 22        # components up to this size: 64 products of them add up exactly in a double
LIMB = 1 << 48         # sums travel in limbs of this size, so none overflows
LARGEST = 1e60
BLOCK = 1024           # rows whose pairs are evaluated at once
STATE = "vec_id string, comps binary, wide array<string>, was int, cluster int, seen binary, at binary, d string"


@dataclass(frozen=True)
class ClusterOptions:
    k: int = 40
    rounds: int = 5
    dim: int = 64
    scale: int = 256
    seed: int = 2


def _kept_rows(vectors: DataFrame, id_col: str, vector_col: str, opts: ClusterOptions) -> DataFrame:
    """``vec_id, comps, wide``: floor(scale * x), as 32-bit integers, or as decimals where these do not hold them."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(LARGEST)))
    rows = vectors.select(F.col(id_col).cast("string").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")) \
        .where((F.size("v") == opts.dim) & fine)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["v"].to_list()) * opts.scale if len(b) else np.zeros((0, opts.dim))
            small = np.abs(x).max(axis=1, initial=0) < EXACT
            ints = np.floor(np.where(small[:, None], x, 0)).astype("<i4")
            yield pd.DataFrame({
                "vec_id": b["vec_id"],
                "comps": [r.tobytes() if ok else None for r, ok in zip(ints, small)],
                "wide": [None if ok else [str(math.floor(c)) for c in r] for r, ok in zip(x, small)],
            }, dtype=object)

    return rows.mapInPandas(whole, "vec_id string, comps binary, wide array<string>")


def _matrix(comps, wide) -> np.ndarray:
    """Rows of integers: 64-bit where every row is small, else Python's own."""
    if all(c is not None for c in comps):
        return np.frombuffer(b"".join(comps), "<i4").astype(np.int64).reshape(len(comps), -1)
    return np.array([[int(x) for x in w] if c is None else np.frombuffer(c, "<i4").tolist()
                     for c, w in zip(comps, wide)], dtype=object)


def _int_rows(rows: list[list[int]]) -> np.ndarray:
    small = max((abs(x) for r in rows for x in r), default=0) <= EXACT
    return np.array(rows, dtype=np.int64 if small else object)


def _norm_up(squared: int) -> float:
    """An upper bound of the root of an integer."""
    return math.isqrt(squared) + 1.0 if squared > 1 << 50 else math.sqrt(squared) * (1 + 1e-12)


def displacements(history: list[list[list[int]]]) -> np.ndarray:
    """``[t, j]``: how far centroid ``j`` is now from where it was in round ``t`` (rounded up)."""
    now = history[-1]
    return np.array([[_norm_up(sum((a - b) ** 2 for a, b in zip(c, old))) for c, old in zip(now, then)]
                     for then in history])


def _pairs(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of matching rows, exactly."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
    diff = x - c
    return (diff * diff).sum(axis=1)


def _roots(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as stored (32-bit) and upper bounds of the roots of integers."""
    root = np.sqrt(squared.astype(np.float64))
    low = np.minimum(root * (1 - 1e-12), np.finfo(np.float32).max).astype(np.float32)
    return np.nextafter(low, np.float32(0)), root * (1 + 1e-12)


def assign(x: np.ndarray, cluster: np.ndarray, seen: np.ndarray, at: np.ndarray, history, drift: np.ndarray):
    """One round for a block of rows: new ``cluster`` and exact squared distances; ``seen``/``at`` are updated.

    ``cluster`` is -1 for rows not yet assigned. ``seen[i, j]`` is a lower bound of the distance of row ``i``
    and centroid ``j`` in round ``at[i, j]``. Returns also how many pairs were evaluated.
    """
    now, t = _int_rows(history[-1]), len(history) - 1
    n, k = seen.shape
    rows = np.arange(n)
    own = np.where(cluster < 0, 0, cluster)
    best = _pairs(x, now[own])
    low, up = _roots(best)
    seen[rows, own], at[rows, own] = low, t
    bound = seen - drift[at, np.arange(k)[None, :]] - 1e-6 * (1 + seen)
    reach = bound <= up[:, None]
    reach[rows, own] = False
    i, j = np.nonzero(reach)
    new = own.copy()
    if len(i):
        d = _pairs(x[i], now[j])
        seen[i, j], at[i, j] = _roots(d)[0], t
        # rows come in order, and in a row centroids by number: a strict improvement, or a tie at a smaller number
        order = np.lexsort((j, d, i)) if d.dtype != object else np.array(
            sorted(range(len(i)), key=lambda p: (i[p], d[p], j[p])), dtype=np.int64)
        first = order[np.unique(i[order], return_index=True)[1]]
        ri, rj, rd = i[first], j[first], d[first]
        better = (rd < best[ri]) | ((rd == best[ri]) & (rj < own[ri]))
        new[ri[better]] = rj[better]
        best[ri[better]] = rd[better]
    return new, best, n + len(i)


def _round(state: DataFrame, history, opts: ClusterOptions) -> DataFrame:
    """The state table after one more assignment to the last centroids of ``history``."""
    k = len(history[-1])
    drift = displacements(history)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["comps"].to_list(), b["wide"].to_list())
            if "cluster" in b:
                cluster = b["cluster"].to_numpy(np.int64)
                seen = np.frombuffer(b"".join(b["seen"]), np.float32).reshape(-1, k).copy()
                at = np.frombuffer(b"".join(b["at"]), np.uint16).reshape(-1, k).copy()
            else:
                cluster = np.full(len(b), -1)
                seen, at = np.zeros((len(b), k), np.float32), np.zeros((len(b), k), np.uint16)
            done = [assign(x[s], cluster[s], seen[s], at[s], history, drift)
                    for s in (slice(p, p + BLOCK) for p in range(0, len(b), BLOCK))]
            yield pd.DataFrame({"vec_id": b["vec_id"], "comps": b["comps"], "wide": b["wide"],
                                "was": cluster.astype(np.int32),
                                "cluster": np.concatenate([new for new, _, _ in done]).astype(np.int32),
                                "seen": [r.tobytes() for r in seen], "at": [r.tobytes() for r in at],
                                "d": [str(v) for _, d, _ in done for v in d]})

    return state.mapInPandas(step, STATE)


def _limbs(n: int) -> Iterator[tuple[int, int]]:
    sign, n, limb = (-1 if n < 0 else 1), abs(n), 0
    while n:
        n, low = divmod(n, LIMB)
        if low:
            yield limb, sign * low
        limb += 1


def _moves(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, list[list[int]]]:
    """Change of the counts and sums of the centroids: what came in less what left, added up by Spark.

    Each task gives at most (limbs x k x (dim + 1)) partial sums; position ``dim`` is the count.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, dim + 1), dtype=object)
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["comps"].to_list(), b["wide"].to_list())
            x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
            for side, sign in (("cluster", 1), ("was", -1)):
                c = b[side].to_numpy()
                for j in np.unique(c[c >= 0]):
                    total[j] += sign * x[c == j].sum(axis=0).astype(object)
        rows = [(j, p, limb, v) for j in range(k) for p in range(dim + 1) for limb, v in _limbs(int(total[j, p]))]
        yield pd.DataFrame(rows, columns=["cluster", "pos", "limb", "v"])

    sums = (state.where("cluster <> was").select("comps", "wide", "cluster", "was")
            .mapInPandas(partial, "cluster int, pos int, limb int, v bigint")
            .groupBy("cluster", "pos", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")))
    counts, out = np.zeros(k, dtype=object), [[0] * dim for _ in range(k)]
    for r in sums.collect():        # at most limbs x k x (dim + 1) rows
        v = int(r.v) * LIMB ** r.limb
        if r.pos == dim:
            counts[r.cluster] += v
        else:
            out[r.cluster][r.pos] += v
    return counts, out


def first_centroids(kept: DataFrame, opts: ClusterOptions) -> list[list[int]]:
    """The ``k`` kept rows whose SHA-256 of ``<seed>:<vec_id>`` is smallest."""
    key = F.sha2(F.concat(F.lit(f"{opts.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = (kept.withColumn("key", key).orderBy(F.asc_nulls_last("key"), "comps", "wide").limit(opts.k)
            .select("comps", "wide").collect())
    return [[int(x) for x in _matrix([r.comps], [r.wide])[0]] for r in rows]


def _long(n: int | None) -> int | None:
    return n if n is not None and abs(n) < 1 << 63 else None


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    opts: ClusterOptions = ClusterOptions()) -> DataFrame:
    """One row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    ``opts.rounds`` rounds assign every vector to its nearest centroid (squared Euclidean distance, ties to
    the smaller number) and replace each non-empty centroid by the floor of its vectors' mean; a last
    assignment follows.
    """
    spark = vectors.sparkSession
    state = written(_kept_rows(vectors, id_col, vector_col, opts), "ns-vectors")
    history = [first_centroids(state, opts)]
    k = len(history[0])
    if not k:
        drop_written(state)
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string")
    counts, sums = np.zeros(k, dtype=object), [[0] * opts.dim for _ in range(k)]
    for _ in range(opts.rounds):
        before, state = state, written(_round(state, history, opts), "ns-state")
        drop_written(before)
        came, moved = _moves(state, k, opts.dim)
        counts = counts + came
        sums = [[a + b for a, b in zip(s, m)] for s, m in zip(sums, moved)]
        history.append([[s // int(n) for s in row] if n else old for row, n, old in zip(sums, counts, history[-1])])
    before, state = state, written(_round(state, history, opts).select("vec_id", "cluster", "d"), "ns-result")
    drop_written(before)

    # one row per centroid
    d = F.expr("try_cast(d AS decimal(38,0))")
    parts = {r.cluster: None if r.part is None or r.beyond else int(r.part) for r in state.groupBy("cluster").agg(
        F.try_sum(d).alias("part"), F.count_if(d.isNull()).alias("beyond")).collect()}
    whole = None if None in parts.values() else sum(parts.values())
    facts = spark.createDataFrame(
        [(j, _long(parts.get(j)), _long(whole), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
         for j, c in enumerate(history[-1])],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "cluster", F.expr("try_cast(d AS bigint)").alias("distance"),
        "cluster_inertia", "inertia", "centroid_sha256")
