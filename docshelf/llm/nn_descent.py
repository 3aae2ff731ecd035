"""Embedding near-dedup by NN-descent.

1. Rows with the same vector form a class; one representative each goes on.
2. Start lists: representatives are sorted by sign-of-projection codes, several times over, and each
   is linked to the best of the rows next to it in each order.
3. NN-descent: the neighbours of each node meet in a local join, forward and (a sample of) reverse,
   and every list keeps its best entries. A list whose entries are all links is saturated and is
   enlarged. Rounds go on until hardly any list changes.
4. Audit: a bounded set of vectors is compared with all by brute force, in blocks. Recall is averaged over
   audited vectors with links, copies counted once, for vectors with few and with many links apart, so that a
   hot group cannot hide lost pairs. While it is under the target, lists and start orders are doubled and
   refined again; after the last try, the vectors are compared exactly, block against block, for links
   between components.
5. List entries near the threshold are verified in double precision; verified links form components.
   A link never leaves its component, so the exact number of links of each vector is counted inside
   components, block against block: pairs are never written out.

Search vectors are quantised to bytes; every decision is taken on the full vectors in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, nor do vectors of different length; repeated vectors link with each other; rows that repeat
an id are rows of their own; a null id comes after all others. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import salted_lookup
from ..session import drop_written
from .common import written
from .components import connected_components


@dataclass(frozen=True)
class DescentOptions:
    threshold: float = 0.95
    slack: float = 0.03          # quantised similarities may be this far off
    lists: int = 10              # entries of a neighbour list at first
    largest_list: int = 160      # saturated lists are enlarged up to this many entries
    tables: int = 24             # start orders
    bits: int = 24               # sign bits of a start code
    window: int = 6              # rows looked at next to one in a start order
    rounds: int = 6
    settled: float = 0.002       # share of changed entries at which rounds end
    audit: int = 1024            # vectors whose links are checked against all others
    recall: float = 0.999        # recall of the audit from which the graph is accepted
    class_least: int = 16        # audited vectors from which those with about as many links are averaged apart
    tries: int = 3               # graphs built before the rest is found by comparing blocks
    salt: int = 8                # tasks over which the copies of one vector are spread
    block: int = 2048            # vectors of a component compared at once


def usable(v) -> np.ndarray | None:
    """The vector at unit length in double precision, or None."""
    if v is None or len(v) == 0:
        return None
    x = np.asarray(v, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.linalg.norm(x)


def _planes(dim: int, opts: DescentOptions) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, opts.tables * opts.bits)).astype(np.float32)


def _encode(nodes: DataFrame, opts: DescentOptions) -> DataFrame:
    """``node, copies, dim, unit (doubles), small (bytes), codes`` of usable vectors."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(opts.bits, dtype=np.int64))[::-1]
        for b in batches:
            rows = []
            for node, copies, v in zip(b["node"], b["copies"], b["vector"]):
                x = usable(v)
                if x is None:
                    continue
                if len(x) not in planes:
                    planes[len(x)] = _planes(len(x), opts)
                signs = (x.astype(np.float32) @ planes[len(x)] > 0).reshape(opts.tables, opts.bits)
                small = np.rint(x / np.abs(x).max() * 127).astype(np.int8)
                rows.append((node, copies, len(x), x.tobytes(), small.tobytes(), signs @ weights))
            yield pd.DataFrame(rows, columns=["node", "copies", "dim", "unit", "small", "codes"])

    return nodes.mapInPandas(read, "node bigint, copies bigint, dim int, unit binary, small binary, codes array<bigint>")


def _bytes(rows) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def start_pairs(coded: DataFrame, opts: DescentOptions) -> DataFrame:
    """``a, b, sim``: for every node the best rows next to it in each start order, both ways."""
    rows = coded.select("node", "dim", "small", F.posexplode("codes").alias("table", "code"))
    parts = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (rows.repartitionByRange(parts, "dim", "table", "code", "node")
               .sortWithinPartitions("dim", "table", "code", "node"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            rest = b.iloc[-opts.window:]
            for _, g in b.groupby("dim", sort=False):
                yield _next_to(g, opts)

    return ordered.mapInPandas(near, "a bigint, b bigint, sim float").distinct()


def _next_to(g: pd.DataFrame, opts: DescentOptions) -> pd.DataFrame:
    x, node, table = _bytes(g["small"].to_list()), g["node"].to_numpy(), g["table"].to_numpy()
    sims = np.full((len(g), 2 * opts.window), -2.0, np.float32)
    other = np.zeros((len(g), 2 * opts.window), np.int64)
    for d in range(1, min(opts.window, len(g) - 1) + 1):
        s = np.where(table[:-d] == table[d:], np.einsum("ij,ij->i", x[:-d], x[d:]), -2.0)
        sims[:-d, 2 * d - 2], other[:-d, 2 * d - 2] = s, node[d:]
        sims[d:, 2 * d - 1], other[d:, 2 * d - 1] = s, node[:-d]
    best = np.argsort(-sims, axis=1, kind="stable")[:, :3]
    at = np.repeat(np.arange(len(g)), best.shape[1])
    out = pd.DataFrame({"a": node[at], "b": other[at, best.ravel()], "sim": sims[at, best.ravel()]})
    return out[out["sim"] > -2.0]


def best_lists(pairs: DataFrame, sizes: DataFrame | None, opts: DescentOptions) -> DataFrame:
    """The best entries of each list; ``sizes`` has the lists that are longer than at first."""
    first = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    once = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    ranked = once.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= opts.largest_list)
    if sizes is None:
        return ranked.where(F.col("rank") <= opts.lists)
    return (ranked.join(sizes, "a", "left").where(F.col("rank") <= F.coalesce("length", F.lit(opts.lists)))
            .drop("length"))


def local_join(lists: DataFrame, coded: DataFrame, opts: DescentOptions) -> DataFrame:
    """``a, b, sim``: neighbours of a common node, each with its best fellows."""
    u = Window.partitionBy("mid").orderBy(F.xxhash64("member", "mid"))
    forward = lists.select(F.col("a").alias("mid"), F.col("b").alias("member"))
    reverse = (lists.select(F.col("b").alias("mid"), F.col("a").alias("member"))
               .withColumn("n", F.row_number().over(u)).where(F.col("n") <= 2 * opts.lists).drop("n"))
    met = (forward.union(reverse).union(lists.select("a", "a")).distinct()
           .join(coded.select(F.col("node").alias("member"), "small"), "member")
           .groupBy("mid").agg(F.collect_list(F.struct("member", "small")).alias("met")))

    def fellows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for met in b["met"]:
                if len(met) < 2:
                    continue
                node = np.array([m["member"] for m in met], np.int64)
                sims = (x := _bytes([m["small"] for m in met])) @ x.T
                np.fill_diagonal(sims, -2.0)
                k = min(4, len(node) - 1)
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                at = np.repeat(np.arange(len(node)), k)
                out.append((node[at], node[best.ravel()], sims[at, best.ravel()]))
            if out:
                yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("a", "b", "sim"))})

    return met.mapInPandas(fellows, "a bigint, b bigint, sim float")


def descend(coded: DataFrame, opts: DescentOptions) -> DataFrame:
    """Refined lists ``a, b, sim, rank``."""
    lists, sizes = written(best_lists(start_pairs(coded, opts), None, opts), "lists"), None
    for _ in range(opts.rounds):
        floor = opts.threshold - opts.slack
        full = (lists.groupBy("a").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("n"))
                .where((F.col("worst") >= floor) & (F.col("n") >= opts.lists))
                .select("a", F.least(F.lit(opts.largest_list), 2 * F.col("n")).alias("length")))
        sizes = written(full if sizes is None else full.union(sizes).groupBy("a").agg(F.max("length").alias("length")),
                        "list-sizes")
        both = lists.select("a", "b", "sim").union(lists.select("b", "a", "sim"))
        new = written(best_lists(both.union(local_join(lists, coded, opts)), sizes, opts), "lists")
        changed = new.join(lists, ["a", "b"], "left_anti").count()
        lists, total = new, lists.count()
        if changed <= opts.settled * total:
            break
    return lists


def links_of(lists: DataFrame, coded: DataFrame, opts: DescentOptions) -> DataFrame:
    """List entries whose cosine in double precision reaches the threshold, as ``a, b`` with a < b."""
    near = (lists.where(F.col("sim") >= opts.threshold - opts.slack)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = [len(x) == len(y) and float(np.frombuffer(x) @ np.frombuffer(y)) >= opts.threshold
                    for x, y in zip(p["x"], p["y"])]
            yield p.loc[np.array(keep, bool), ["a", "b"]]

    return (near.join(coded.select(F.col("node").alias("a"), F.col("unit").alias("x")), "a")
            .join(coded.select(F.col("node").alias("b"), F.col("unit").alias("y")), "b")
            .mapInPandas(test, "a bigint, b bigint"))


def counted(labels: DataFrame, coded: DataFrame, opts: DescentOptions) -> DataFrame:
    """``node, n, others``: exact number of links of each node in its component, without its own copies,
    and the same with copies counted once.

    Components up to a block share groups of about a block; larger ones meet block by block.
    """
    rows = labels.join(coded.select("node", "copies", "dim", "unit"), "node")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    rows = rows.join(sizes, "label")
    small = F.col("size") <= opts.block
    groups = max(1, labels.count() // opts.block)
    blocks = F.ceil(F.col("size") / opts.block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    placed = (rows.withColumn("own", F.when(small, F.lit(0)).otherwise(own))
              .withColumn("meets", F.explode(F.when(small, F.array(F.lit(0)))
                                             .otherwise(F.sequence(F.lit(0), blocks - 1))))
              .select("node", "copies", "unit", "label", "dim", "own",
                      F.when(small, F.lit(-1) - F.pmod(F.xxhash64("label"), F.lit(groups))).otherwise(F.col("label")).alias("team"),
                      F.least("own", "meets").alias("low"), F.greatest("own", "meets").alias("high")))

    def count(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in g.groupby("dim"):
            x = np.frombuffer(b"".join(same["unit"])).reshape(len(same), -1)
            label, copies, node = (same[c].to_numpy() for c in ("label", "copies", "node"))
            low = (same["own"] == same["low"]).to_numpy()
            one = bool((same["low"] == same["high"]).all())
            sides = [(np.arange(len(x)), np.arange(len(x)))] if one else [(np.flatnonzero(low), np.flatnonzero(~low)),
                                                                          (np.flatnonzero(~low), np.flatnonzero(low))]
            for left, right in sides:
                for at in range(0, len(left), 512):
                    i = left[at:at + 512]
                    near = (x[i] @ x[right].T >= opts.threshold) & (label[i][:, None] == label[right][None, :])
                    near &= i[:, None] != right[None, :]
                    out.append(pd.DataFrame({"node": node[i], "n": near @ copies[right], "others": near.sum(axis=1)}))
        return pd.concat(out)

    return (placed.groupBy("team", "low", "high").applyInPandas(count, "node bigint, n bigint, others bigint")
            .groupBy("node").agg(F.sum("n").alias("n"), F.sum("others").alias("others")))


def links_between(labels: DataFrame, coded: DataFrame, opts: DescentOptions) -> DataFrame:
    """Links ``a, b`` between vectors of different components, enough of them to join those components.

    Exact: every block of vectors meets every other. A task holds two blocks and gives a spanning forest of
    the components it joins, so never more rows than vectors. The work grows with the square of the vectors,
    which is why it only follows when no graph has passed the audit.
    """
    blocks = max(1, -(-coded.count() // opts.block))
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    placed = (coded.join(labels, "node", "left")
              .select("node", "dim", "unit", F.coalesce("label", "node").alias("label"), own.alias("own"))
              .withColumn("meets", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
              .withColumn("low", F.least("own", "meets")).withColumn("high", F.greatest("own", "meets")).drop("meets"))

    def join(g: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(g["unit"])).reshape(len(g), -1)
        node, label = g["node"].to_numpy(), g["label"].to_numpy()
        one = g["low"].iloc[0] == g["high"].iloc[0]
        low = (g["own"] == g["low"]).to_numpy()
        left, right = (np.arange(len(g)),) * 2 if one else (np.flatnonzero(low), np.flatnonzero(~low))
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        out = []
        for at in range(0, len(left), 512):
            i = left[at:at + 512]
            r, c = np.nonzero((x[i] @ x[right].T >= opts.threshold) & (label[i][:, None] != label[right][None, :]))
            _, firsts = np.unique(np.stack([label[i[r]], label[right[c]]]), axis=1, return_index=True)
            for k in firsts:
                a, b = i[r[k]], right[c[k]]
                if (p := top(label[a])) != (q := top(label[b])):
                    root[p] = q
                    out.append((min(node[a], node[b]), max(node[a], node[b])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return placed.groupBy("dim", "low", "high").applyInPandas(join, "a bigint, b bigint")


def audited_recall(coded: DataFrame, counts: DataFrame, opts: DescentOptions) -> float:
    """Recall of links of a bounded set of vectors, compared with all in blocks; copies count once.

    The mean over the audited vectors that have links, or the least mean of those with about as many links
    (powers of two) where enough were audited. 1 if none has a link.
    """
    asked = coded.orderBy(F.xxhash64("node"), "node").limit(opts.audit).select("node", "dim", "unit").collect()
    by_dim: dict[int, tuple] = {}
    for r in asked:
        by_dim.setdefault(r["dim"], ([], []))[0].append(r["node"])
        by_dim[r["dim"]][1].append(np.frombuffer(r["unit"]))
    by_dim = {d: (np.array(n), np.array(x)) for d, (n, x) in by_dim.items()}

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby("dim"):
                if dim in by_dim:
                    nodes, q = by_dim[dim]
                    x = np.frombuffer(b"".join(g["unit"])).reshape(len(g), -1)
                    near = (q @ x.T >= opts.threshold) & (nodes[:, None] != g["node"].to_numpy()[None, :])
                    yield pd.DataFrame({"node": nodes, "n": near.sum(axis=1)})

    true = (coded.select("node", "dim", "unit").mapInPandas(brute, "node bigint, n bigint")
            .groupBy("node").agg(F.sum("n").alias("true")).where(F.col("true") > 0))
    found = F.least("true", F.coalesce("others", F.lit(0))) / F.col("true")
    sums = (true.join(counts, "node", "left").groupBy(F.floor(F.log2("true")).alias("size"))
            .agg(F.count(F.lit(1)).alias("vectors"), F.sum(found).alias("recall")).collect())      # one row per power of two
    if not sums:
        return 1.0
    means = [s["recall"] / s["vectors"] for s in sums if s["vectors"] >= opts.class_least]
    return min([sum(s["recall"] for s in sums) / sum(s["vectors"] for s in sums), *means])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 opts: DescentOptions = DescentOptions()) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept, audit_recall``."""
    rows = written(vectors.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("vec_id"),
                                  F.col(vector_col).cast("array<double>").alias("vector")), "vectors")
    order = F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "row_key")
    classes = written(rows.where("vector is not null").groupBy("vector")
                      .agg(F.min(order).alias("rep"), F.count(F.lit(1)).alias("copies"))
                      .select("vector", F.col("rep.row_key").alias("node"), F.col("rep.vec_id").alias("rep_id"), "copies"),
                      "vector-classes")
    for attempt in range(opts.tries):
        coded = written(_encode(classes.select("node", "copies", "vector"), opts), "coded")
        labels = written(connected_components(links_of(descend(coded, opts), coded, opts)), "labels")
        counts = written(counted(labels, coded, opts), "link-counts")
        recall = audited_recall(coded, counts, opts)
        if recall >= opts.recall:
            break
        if attempt + 1 < opts.tries:
            for table in (coded, labels, counts):
                drop_written(table)
            opts = replace(opts, lists=2 * opts.lists, largest_list=2 * opts.largest_list, tables=2 * opts.tables)
    else:
        inside = labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))
        labels = written(connected_components(inside.union(links_between(labels, coded, opts))), "labels")
        counts = written(counted(labels, coded, opts), "link-counts")
        recall = audited_recall(coded, counts, opts)
    first = F.struct(F.col("rep_id").isNull().alias("no_id"), F.col("rep_id").alias("id"), F.col("node").alias("key"))
    reps = (classes.join(coded.select("node"), "node", "left_semi").join(labels, "node", "left")
            .join(counts, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.col("copies") - 1))
    tops = reps.where("label is not null").groupBy("label").agg(F.min(first).alias("top"))
    resolved = written(
        reps.where("label is not null").join(tops, "label").select("vector", "node", "copies", "n", "top")
        .union(reps.where("label is null and copies > 1").select("vector", "node", "copies", "n", first.alias("top"))),
        "resolved")
    # a vector of its own is found by its row; only vectors with copies are looked up, their rows spread
    own = resolved.where("copies = 1").select(F.col("node").alias("row_key"), "n", "top")
    shared = resolved.where("copies > 1").select("vector", F.col("n").alias("shared_n"), F.col("top").alias("shared_top"))
    found = (salted_lookup(rows, shared, ["vector"], ["row_key"], opts.salt, "left").drop("vector")
             .join(own, "row_key", "left")
             .withColumn("n", F.coalesce("n", "shared_n")).withColumn("top", F.coalesce("top", "shared_top")))
    alone = F.col("top").isNull()
    return found.select("vec_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_links"),
                        F.when(alone, F.col("vec_id")).otherwise(F.col("top.id")).alias("component_id"),
                        (alone | (F.col("row_key") == F.col("top.key"))).alias("kept"),
                        F.lit(float(recall)).alias("audit_recall"))
